"""What is told about routes: totals, leg statistics, connections, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.config import Period
from transit_spark.functions.geo import MILE
from transit_spark.operators.frequency import effective_frequency


def route_summary(legs: DataFrame, classes: int = 3, p: Period = Period()) -> DataFrame:
    """Totals of each route of ``legs`` (route_id, leg_no, kind, time, freq, dist, miles): bottleneck, boardings, ride_s, walk_s, wait_s (half of each
    headway), longest_walk, expected_s, miles by class and on demand."""
    on = F.col("kind").isin("ride", "flex")
    walk = F.col("kind") == "walk"
    mile = lambda k: F.sum(F.when(F.col("kind") == "ride", F.coalesce(F.get("miles", F.lit(k)), F.lit(0.0))).otherwise(0.0)).alias(f"miles_{k}")
    out = legs.groupBy("route_id").agg(
        F.min(F.when(on, F.col("freq"))).alias("bottleneck"), F.sum(on.cast("int")).alias("boardings"), F.sum(F.when(on, F.col("time")).otherwise(0.0)).alias("ride_s"),
        F.sum(F.when(walk, F.col("time")).otherwise(0.0)).alias("walk_s"), F.sum(F.when(on, p.seconds / F.col("freq") / 2).otherwise(0.0)).alias("wait_s"),
        F.coalesce(F.max(F.when(walk, F.col("dist"))), F.lit(0.0)).alias("longest_walk"), *[mile(k) for k in range(classes)], F.sum(F.when(F.col("kind") == "flex", F.col("dist") / MILE).otherwise(0.0)).alias("miles_flex"))
    return out.withColumn("expected_s", F.col("ride_s") + F.col("walk_s") + F.col("wait_s"))


def profile_summary(profile: DataFrame) -> DataFrame:
    """route_id, connections, min, median, max seconds of a connection, cut to whole ones."""
    d = F.col("arr") - F.col("dep")
    return profile.groupBy("route_id").agg(F.count("*").alias("connections"), F.min(d).cast("bigint").alias("min"), F.floor(F.median(d)).cast("bigint").alias("median"), F.max(d).cast("bigint").alias("max"))


def ride_stats(options: DataFrame, patterns: DataFrame, p: Period = Period()) -> DataFrame:
    """Per leg of ``options`` (route_id, leg_no, pattern_id, dep): distinct departures in the window and all day, first, last, headway, and the four
    services with most departures in the window, later names first among equals; services without one aren't listed. ``patterns``: pattern_id, agency, route_name."""
    keys = ["route_id", "leg_no"]
    inside = F.col("dep").between(p.start, p.end - 1)
    out = options.groupBy(*keys).agg(F.countDistinct(F.when(inside, F.col("dep"))).alias("in_window"), F.countDistinct("dep").alias("all_day"), F.min("dep").alias("first"), F.max("dep").alias("last"))
    freq = effective_frequency(options.select(*keys, "dep").distinct(), keys, "dep", p.start, p.end)
    out = out.join(freq.select(*keys, F.when(F.col("freq") > 0, p.seconds / F.col("freq")).alias("headway")), keys)
    named = options.where(inside).join(patterns.select("pattern_id", "agency", "route_name"), "pattern_id").groupBy(*keys, "agency", "route_name").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), F.desc("agency"), F.desc("route_name")))
    top = named.withColumn("place", place).where("place <= 4").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "agency", "route_name", "n"))).alias("services"))
    return out.join(top, keys, "left")


def describe_legs(legs: DataFrame, nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """``legs`` with names and places of their ends, their ride statistics, and whether they are the bottleneck of their route."""
    end = lambda x: nodes.select(F.col("node").alias(x), F.struct("stop_id", "name", "lat", "lon").alias("from" if x == "u" else "to"))
    low = F.min("freq").over(W.partitionBy("route_id"))
    out = legs.withColumn("bottleneck", F.coalesce(F.abs(F.col("freq") - low) < 0.005, F.lit(False)))
    return out.join(end("u"), "u", "left").join(end("v"), "v", "left").join(stats, ["route_id", "leg_no"], "left")


def route_feeds(legs: DataFrame, options: DataFrame, patterns: DataFrame, zones: DataFrame, manifest: DataFrame) -> DataFrame:
    """route_id, feed_id, note of the feeds whose trips serve a route, and of those feeds of the manifest that are the source of its zones; note where the
    feed's calendar is over. Patterns and zones grow with the data and are shuffled; feeds are few."""
    known = manifest.select("feed_id").distinct()
    ridden = options.select("route_id", "pattern_id").distinct().join(patterns.select("pattern_id", "feed_id").hint("merge"), "pattern_id").select("route_id", "feed_id")
    taken = legs.where("kind = 'flex'").select("route_id", "zone_id").join(zones.select("zone_id", F.col("source").alias("feed_id")).hint("merge"), "zone_id").select("route_id", "feed_id").join(known, "feed_id", "left_semi").select("route_id", "feed_id")
    note = F.when(F.col("stale"), F.concat(F.lit("calendar ended "), F.substring("service_end", 1, 10)))
    return ridden.unionByName(taken).distinct().join(manifest.select("feed_id", note.alias("note")), "feed_id", "left")
