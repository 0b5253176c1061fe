"""Timetable feeds: zips or folders of CSV tables, and the compiled timetable."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The tables of a feed and the columns that jobs read.
TABLES = {
    "agency": ["agency_id", "agency_name"],
    "routes": ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"],
    "trips": ["route_id", "service_id", "trip_id", "trip_headsign", "shape_id"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "frequencies": ["trip_id", "start_time", "end_time", "headway_secs"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "pickup_type", "drop_off_type", "location_id", "start_pickup_drop_off_window", "end_pickup_drop_off_window"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
}
REQUIRED = ("routes", "trips", "stop_times", "stops")


def feed_rows(zips: DataFrame, tables: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """feed_id, table, row_no, cells of all rows of ``tables`` in ``zips`` (path, content), in one pass over each zip; cells are the table's wanted columns in order.

    Headers lose blanks and a byte order mark, values leading blanks; a wanted column that a feed lacks is empty, over-long
    rows are skipped, null is "". A table may be in a folder of the zip. A feed without it has no rows, or fails where
    it is ``required``. Rows leave a task in batches; one zip is read by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                feed = path.rsplit("/", 1)[-1].removesuffix(".zip")
                with zipfile.ZipFile(io.BytesIO(content)) as files:
                    members = sorted(files.namelist(), key=len)
                    for name, columns in tables.items():
                        member = next((m for m in members if m.rsplit("/", 1)[-1] == f"{name}.txt"), None)
                        if member is None and name in required:
                            raise FileNotFoundError(f"{name}.txt in {path}")
                        if member is not None:
                            with files.open(member) as raw:
                                yield from _rows(feed, name, columns, raw)

    return zips.select("path", "content").mapInArrow(run, "feed_id string, table string, row_no bigint, cells array<string>")


def _rows(feed: str, name: str, columns: list[str], raw: IO[bytes], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", "replace", newline=""), skipinitialspace=True)
    head = [h.strip() for h in next(rows, [])]
    at = [head.index(c) if c in head else -1 for c in columns]
    numbers: list[int] = []
    cells: list[list[str]] = []

    def batch() -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays([pa.array([feed] * n), pa.array([name] * n), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["feed_id", "table", "row_no", "cells"])

    for i, row in enumerate(rows):
        if row and len(row) <= len(head):
            numbers.append(i)
            cells.append([row[j] if 0 <= j < len(row) else "" for j in at])
        if len(numbers) >= most:
            yield batch()
            numbers, cells = [], []
    if numbers:
        yield batch()


def zip_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all zips at ``path``, two gigabytes each at most."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")


def named_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("feed_id", "row_no", *[F.col("cells")[i].alias(c) for i, c in enumerate(columns)])


def read_gtfs_table(spark: SparkSession, path: str, name: str, columns: list[str], required: bool = True) -> DataFrame:
    """feed_id, row_no and ``columns``, all strings, of table ``name`` in all zips at ``path`` (feed_id is the zip's name); see ``feed_rows``. For several
    tables ``unpack_feeds`` reads each zip once."""
    return named_cells(feed_rows(zip_files(spark, path), {name: columns}, (name,) if required else ()), columns)


def unpack_feeds(spark: SparkSession, path: str, out: str, tables: dict[str, list[str]] = TABLES, required: tuple[str, ...] = REQUIRED) -> None:
    """All wanted tables of all zips at ``path`` as Parquet below ``out``, parted by table, in one pass over each zip."""
    feed_rows(zip_files(spark, path), tables, required).write.mode("overwrite").partitionBy("table").parquet(out)


def read_unpacked(spark: SparkSession, out: str, name: str, tables: dict[str, list[str]] = TABLES) -> DataFrame:
    """What ``read_gtfs_table`` gives for a table that ``unpack_feeds`` wrote: only its part of the files is read."""
    kind = "feed_id string, row_no bigint, cells array<string>, table string"
    return named_cells(spark.read.schema(kind).parquet(out).where(F.col("table") == name), tables[name])


def read_gtfs_folder(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """The same of unpacked feeds, folders feed_id=*/ at ``path``: read by Spark's CSV source, split within files. Feeds with other
    columns are read by name; row_no grows within a feed."""
    out = None
    for folder in sorted(r.folder for r in spark.read.format("binaryFile").option("pathGlobFilter", f"{name}.txt").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).collect()):
        raw = spark.read.csv(f"{folder}/{name}.txt", header=True, inferSchema=False, ignoreLeadingWhiteSpace=True)
        raw = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
        own = raw.select(F.lit(folder.rsplit("feed_id=", 1)[-1]).alias("feed_id"), F.monotonically_increasing_id().alias("row_no"), *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "feed_id string, row_no bigint, " + ", ".join(f"{c} string" for c in columns))


def read_shapes(shapes: DataFrame, patterns: DataFrame) -> DataFrame:
    """feed_id, shape_id, seq, lat, lon of the shapes that patterns use; points without a number are dropped."""
    number = lambda c, t: F.expr(f"try_cast(trim({c}) as {t})")
    rows = shapes.select("feed_id", F.trim("shape_id").alias("shape_id"), number("shape_pt_sequence", "int").alias("seq"), number("shape_pt_lat", "double").alias("lat"), number("shape_pt_lon", "double").alias("lon"))
    return rows.dropna().join(patterns.select("feed_id", F.trim("shape_id").alias("shape_id")).distinct(), ["feed_id", "shape_id"], "left_semi")


#: Counts up when compiled timetables of before can't be used any more.
COMPILE_VERSION = 1


def feeds_to_compile(spark: SparkSession, wanted: DataFrame, path: str, version: int = COMPILE_VERSION) -> DataFrame:
    """Those of ``wanted`` (feed_id, dataset_id, target, ...) whose dataset isn't compiled for that date at ``path`` yet, in this version."""
    done = compiled_feeds(spark, path)
    return wanted if done is None else wanted.join(done.where(F.col("version") == version).select("feed_id", "dataset_id", "target"), ["feed_id", "dataset_id", "target"], "left_anti")


def compiled_feeds(spark: SparkSession, path: str) -> DataFrame | None:
    """feed_id, dataset_id, target, service_date, version of the timetables at ``path``; None where there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/feeds")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema("feed_id string, dataset_id string, target string, service_date date, version int").parquet(f"{path}/feeds")


def write_timetable(feeds: DataFrame, patterns: DataFrame, pattern_stops: DataFrame, pattern_times: DataFrame, path: str, version: int = COMPILE_VERSION) -> None:
    """The three tables of compiled ``feeds`` (feed_id, dataset_id, target, service_date) below ``path``, parted by feed and service date; parts of other feeds and dates
    stay. A feed is listed last, so one whose tables were cut off is compiled again."""
    day = F.broadcast(feeds.select("feed_id", "service_date"))  # one row a feed
    for name, df in (("patterns", patterns), ("pattern_stops", pattern_stops), ("pattern_times", pattern_times)):
        df.drop("service_date").join(day, "feed_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed_id", "service_date").parquet(f"{path}/{name}")
    feeds.select("feed_id", "dataset_id", "target", F.col("service_date").cast("date").alias("service_date"), F.lit(version).alias("version")).write.mode("append").parquet(f"{path}/feeds")
