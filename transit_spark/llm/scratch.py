"""Tables that cut lineage, written to the folder which driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset (local tests) in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext.getCheckpointDir()
        if kept is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        if kept is None:
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
            kept = spark.sparkContext.getCheckpointDir()
        root = kept
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written once and read again: later jobs, and tasks run anew after a lost executor, see the same rows."""
    path = folder(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Held:
    """Tables of a step, deleted together when its result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(keep(df))
        return self.tables[-1]

    def discard(self) -> None:
        discard(*self.tables)
        self.tables = []


def discard(*kept: DataFrame) -> None:
    """Deletes tables that ``keep`` wrote, after their last reader."""
    for df in kept:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession, pause: float = 1.5) -> None:
    """Asks Python and the driver's JVM to collect their garbage: Spark removes the shuffle files of steps whose results
    are kept when the driver has forgotten those steps, which else takes until its heap fills. Executors remove them meanwhile, so
    the next step, which may write as much, begins after a pause; what the first collection only let go of, the second finds."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
