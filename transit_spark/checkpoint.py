"""Cutting of lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that executors share, which the session names in spark.checkpoint.dir; only a local
    session without one gets a temporary folder, as a cluster would lose its files."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet, which packs lists and repeated values, to the shared folder and read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, pause: float = 1.0) -> None:
    """Lets Spark delete the shuffles of tables that are kept, which else stay until the driver's heap fills: the next step may write as much."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


#: Rows that a task sorts at once.
TASK_ROWS = 250_000


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of ``rows``: those of the session, and more where its tasks would have over TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its rows (``rows``, else counted) need, so that a task's memory doesn't grow with the data."""
    return df.repartition(parts(df.sparkSession, df.count() if rows is None else rows), *keys)


def sorted_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once, dealt and sorted by ``key``: joins on it alone move and sort only their other side."""
    whole = keep(df)
    return cut_dealt(dealt(whole, key).sortWithinPartitions(key))


def cut_dealt(df: DataFrame) -> DataFrame:
    """``cut`` of a table that is dealt and sorted already, which later joins are told: an adaptive plan doesn't keep how its rows are dealt, so that each join
    would move them again."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
