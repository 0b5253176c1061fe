"""Effective frequencies and pooled ride edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.operators.timetable import first_per_key


def effective_frequency(df: DataFrame, keys: list[str], dep: str = "dep", w0: int = 21600, w1: int = 79200) -> DataFrame:
    """keys, freq: window squared over the sum of squared gaps between departures in [w0, w1), the last gap going round to
    the first; so n even departures have n, bunched ones fewer. Keys without a departure in the window have 0."""
    span = w1 - w0
    inside = F.when((F.col(dep) >= w0) & (F.col(dep) < w1), F.col(dep).cast("double"))
    ordered = df.select(*keys, inside.alias("_d")).withColumn("_gap", F.lead("_d").over(W.partitionBy(*keys).orderBy(F.col("_d").asc_nulls_last())) - F.col("_d"))
    round_ = (F.lit(w1) - F.max("_d")) + (F.min("_d") - F.lit(w0))
    squares = F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0.0)) + round_ * round_
    return ordered.groupBy(*keys).agg(F.when(F.count("_d") > 0, F.lit(float(span) * span) / F.greatest(squares, F.lit(1.0))).otherwise(0.0).alias("freq"))


def running_profile(pattern_times: DataFrame, w0: int = 21600, w1: int = 79200) -> DataFrame:
    """pattern_id, pos, dep_med, arr_med: medians of times after the first departure, over trips with any departure in the window."""
    trip = W.partitionBy("pattern_id", "trip_no")
    rows = pattern_times.withColumns({"_any": F.max(F.col("dep").between(w0, w1 - 1)).over(trip), "_dep0": F.first("dep").over(trip.orderBy("pos"))}).where("_any")
    return rows.groupBy("pattern_id", "pos").agg(F.median(F.col("dep") - F.col("_dep0")).alias("dep_med"), F.median(F.col("arr") - F.col("_dep0")).alias("arr_med"))


def merge_mirrored_patterns(pattern_stops: DataFrame, pattern_times: DataFrame, miles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pattern_stops, pattern_times) in which patterns of any feeds with equal (node, board, alight) sequences, and equal
    class miles in tenths where given (pattern_id, pos, miles array), are one; of its trips one per first departure stays."""
    rows = pattern_stops
    place = [F.col("pos"), F.col("node"), F.col("board"), F.col("alight")]
    if miles is not None:
        rows = rows.join(miles.select("pattern_id", "pos", F.transform("miles", lambda m: F.bround(m, 1)).alias("tenths")), ["pattern_id", "pos"], "left")
        place.append(F.col("tenths"))
    keyed = rows.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct(*place))).alias("key"))
    first = keyed.groupBy("key").agg(F.min("pattern_id").alias("merged"))
    named = keyed.join(first, "key").select("pattern_id", "merged")
    times = pattern_times.join(named, "pattern_id")
    times = times.withColumn("dep0", F.first("dep").over(W.partitionBy("pattern_id", "trip_no").orderBy("pos")))
    chosen = first_per_key(times.select("merged", "pattern_id", "trip_no", "dep0").distinct(), ["merged", "dep0"], ["pattern_id", "trip_no"])
    chosen = chosen.withColumn("new_no", F.row_number().over(W.partitionBy("merged").orderBy("dep0"))).drop("dep0")
    out = times.join(chosen, ["merged", "pattern_id", "trip_no"]).select(F.col("merged").alias("pattern_id"), F.col("new_no").alias("trip_no"), "pos", "dep", "arr")
    return pattern_stops.join(first.select(F.col("merged").alias("pattern_id")), "pattern_id", "left_semi"), out


def merge_stops(stops: DataFrame, feed_rank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, mapping): stops with the same id and the same coordinates to four decimals are one node, described by the
    first in feed order. ``node`` is a 64-bit hash of id and rounded coordinates, so no global numbering is needed."""
    node = F.xxhash64("stop_id", F.bround(F.col("lat"), 4), F.bround(F.col("lon"), 4))
    rows = stops.join(feed_rank, "feed_id").withColumn("node", node)
    nodes = first_per_key(rows, ["node"], ["feed_rank", "feed_id", "stop_id"]).select("node", "stop_id", "name", "lat", "lon", "feed_id")
    return nodes, rows.select("feed_id", "stop_id", "node").distinct()


def stop_pairs(pattern_stops: DataFrame, freq: DataFrame, profile: DataFrame, miles: DataFrame, *keys: str) -> DataFrame:
    """u, v, freq, time, miles, and ``keys`` (pattern_id or none), of all i < j of a pattern where i boards, j alights and i has departures. ``miles``
    (pattern_id, pos, miles array) is cumulative. Stops without departures go before the join, which is on the pattern."""
    rows = pattern_stops.join(profile, ["pattern_id", "pos"]).join(miles.select("pattern_id", "pos", "miles"), ["pattern_id", "pos"])
    left = rows.where("board").join(freq.where("freq > 0"), ["pattern_id", "pos"]).select("pattern_id", F.col("pos").alias("i"), F.col("node").alias("u"), "freq", "dep_med", F.col("miles").alias("m0"))
    right = rows.where("alight").select("pattern_id", F.col("pos").alias("j"), F.col("node").alias("v"), "arr_med", F.col("miles").alias("m1"))
    out = left.join(right, "pattern_id").where("i < j and u <> v")
    return out.select(*keys, "u", "v", "freq", F.greatest(F.col("arr_med") - F.col("dep_med"), F.lit(30.0)).cast("double").alias("time"), F.zip_with("m1", "m0", lambda a, b: a - b).alias("miles"))


def dominant_class(miles: Column) -> Column:
    """The first class with the most miles."""
    return (F.array_position(miles, F.array_max(miles)) - 1).cast("int")


def pool_edges(pairs: DataFrame, classes: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, u, v, cls, freq, time, miles_0, ...: parallel rides of one dominant class pooled, times and miles weighted by frequency."""
    weighted = lambda c: F.sum(c * F.col("freq")) / F.sum("freq")
    own = pairs.withColumn("cls", dominant_class(F.col("miles")))
    return own.groupBy(*keys, "u", "v", "cls").agg(F.sum("freq").alias("freq"), weighted(F.col("time")).alias("time"), *[weighted(F.col("miles")[k]).alias(f"miles_{k}") for k in range(classes)])
