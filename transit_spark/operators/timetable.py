"""From raw timetable tables to stop patterns and their trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.checkpoint import cut
from transit_spark.config import BUS_ROUTE_TYPES, EXCLUDED_AGENCIES
from transit_spark.functions.text import parse_gtfs_time, route_display_name


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def exclude_by_pattern(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose column matches none of the regexes, in whatever case; null matches none."""
    if not patterns:
        return df
    return df.where(~F.coalesce(F.col(column), F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def bus_routes(routes: DataFrame, agency: DataFrame, feeds: DataFrame, route_types: tuple[int, ...] = BUS_ROUTE_TYPES, exclude: Sequence[str] = EXCLUDED_AGENCIES) -> DataFrame:
    """feed_id, route_id, route_name, agency, route_short_name, route_long_name of bus routes whose agency no pattern of ``exclude`` finds; ``feeds`` (feed_id, provider) names the agency where no table does."""
    kept = routes.where(F.expr("try_cast(trim(route_type) as double)").isin(*[float(t) for t in route_types]))
    kept = first_per_key(kept, ["feed_id", "route_id"], ["row_no"])
    named = first_per_key(agency, ["feed_id", "agency_id"], ["row_no"]).select("feed_id", "agency_id", F.nullif(F.trim("agency_name"), F.lit("")).alias("own"))
    first = agency.groupBy("feed_id").agg(F.min_by(F.nullif(F.trim("agency_name"), F.lit("")), "row_no").alias("first"))
    out = kept.join(named, ["feed_id", "agency_id"], "left").join(first, "feed_id", "left").join(feeds.select("feed_id", "provider"), "feed_id", "left")
    out = out.select("feed_id", "route_id", route_display_name(F.col("route_short_name"), F.col("route_long_name"), F.col("route_id")).alias("route_name"), F.coalesce("own", "first", "provider").alias("agency"), "route_short_name", "route_long_name")
    return exclude_by_pattern(out, "agency", exclude)


def valid_stops(stops: DataFrame, stop_times: DataFrame) -> DataFrame:
    """feed_id, stop_id, name, lat, lon of used stops with real coordinates; the first row of an id counts."""
    out = stops.select("feed_id", "row_no", F.trim("stop_id").alias("stop_id"), F.col("stop_name").alias("name"), F.expr("try_cast(trim(stop_lat) as double)").alias("lat"), F.expr("try_cast(trim(stop_lon) as double)").alias("lon"))
    out = first_per_key(out.where("abs(lat) > 1 and abs(lon) > 1"), ["feed_id", "stop_id"], ["row_no"]).drop("row_no")
    return out.join(stop_times.select("feed_id", F.trim("stop_id").alias("stop_id")).distinct(), ["feed_id", "stop_id"], "left_semi")


def fill_times(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` (keys, pos, arr, dep) with blank times filled linearly by row position, after each is filled from the other;
    trips without a time at an end are dropped."""
    both = df.withColumns({"arr": F.coalesce("arr", "dep"), "dep": F.coalesce("dep", "arr")})
    whole = W.partitionBy(*keys)
    order = whole.orderBy("pos")
    ends = F.first("arr").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).isNotNull() & F.last("arr").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).isNotNull()
    both = both.withColumns({"_ok": ends, "_row": F.row_number().over(order)}).where("_ok").drop("_ok")
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    for c in ("arr", "dep"):
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("row"), F.col(c).alias("t")))
        a, b = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
        both = both.withColumns({"_a": a, "_b": b})
        line = F.col("_a.t") + (F.col("_b.t") - F.col("_a.t")) * (F.col("_row") - F.col("_a.row")) / F.greatest(F.col("_b.row") - F.col("_a.row"), F.lit(1))
        both = both.withColumn(c, F.rint(line).cast("int")).drop("_a", "_b")
    return both.drop("_row")


def clean_stop_times(stop_times: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """feed_id, trip_id, pos, stop_id, board, alight, arr, dep of the trips' usable rows, in order from 1."""
    rows = stop_times.select(
        "feed_id", "row_no", F.trim("trip_id").alias("trip_id"), F.trim("stop_id").alias("stop_id"), F.expr("try_cast(trim(stop_sequence) as double)").alias("seq"),
        (F.trim(F.coalesce("pickup_type", F.lit(""))) != "1").alias("board"), (F.trim(F.coalesce("drop_off_type", F.lit(""))) != "1").alias("alight"),
        parse_gtfs_time(F.col("arrival_time")).alias("arr"), parse_gtfs_time(F.col("departure_time")).alias("dep"),
    ).where("stop_id <> '' and seq is not null and not isnan(seq)")
    rows = rows.join(trips.select("feed_id", "trip_id").distinct(), ["feed_id", "trip_id"], "left_semi").join(stops.select("feed_id", "stop_id"), ["feed_id", "stop_id"], "left_semi")
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("feed_id", "trip_id").orderBy("seq", "row_no")))
    return fill_times(rows.select("feed_id", "trip_id", "pos", "stop_id", "board", "alight", "arr", "dep"), ["feed_id", "trip_id"])


def expand_frequencies(stop_times: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``stop_times`` and copy_no: a trip with frequencies becomes a copy every headway in [start, end), and loses its own time."""
    times = frequencies.select("feed_id", F.trim("trip_id").alias("trip_id"), parse_gtfs_time(F.col("start_time")).alias("f0"), parse_gtfs_time(F.col("end_time")).alias("f1"), F.expr("try_cast(trim(headway_secs) as double)").alias("h"))
    times = times.where("f0 is not null and f1 is not null and h > 0 and not isnan(h)")
    starts = times.where("f1 > f0").withColumn("t0", F.explode(F.expr("transform(sequence(0, cast(ceil((f1 - f0) / h) as int) - 1), i -> f0 + i * h)"))).select("feed_id", "trip_id", "t0").distinct()
    starts = starts.withColumn("copy_no", F.row_number().over(W.partitionBy("feed_id", "trip_id").orderBy("t0")))
    own = stop_times.withColumn("_dep0", F.first("dep").over(W.partitionBy("feed_id", "trip_id").orderBy("pos")))
    listed = own.join(starts, ["feed_id", "trip_id"]).withColumns({c: F.rint(F.col(c) + F.col("t0") - F.col("_dep0")).cast("int") for c in ("arr", "dep")}).drop("t0", "_dep0")
    plain = own.join(times.select("feed_id", "trip_id").distinct(), ["feed_id", "trip_id"], "left_anti").drop("_dep0").withColumn("copy_no", F.lit(0))
    return plain.unionByName(listed)


def compile_patterns(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns, pattern_stops, pattern_times): trips of a route with equal ordered (stop, board, alight) are one pattern.

    pattern_id is a 64-bit hash of feed, route and sequence. Sequences under two stops are dropped. The headsign is that of the
    first trip id, the shape the most frequent one (the least of equally frequent ones). Trips that leave at the same
    time as an earlier trip id of the pattern are dropped.
    """
    kept = stop_times.join(trips.select("feed_id", "trip_id", "route_id", "trip_headsign", "shape_id"), ["feed_id", "trip_id"])
    kept = kept.join(routes.select("feed_id", "route_id", "route_name", "agency"), ["feed_id", "route_id"])
    one = kept.groupBy("feed_id", "route_id", "route_name", "agency", "trip_id", "copy_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "stop_id", "board", "alight", "arr", "dep"))).alias("rows"), F.first("trip_headsign").alias("headsign"), F.first("shape_id").alias("shape_id"))
    one = one.where(F.size("rows") >= 2)
    places = F.transform("rows", lambda r: F.struct(r["stop_id"].alias("stop_id"), r["board"].alias("board"), r["alight"].alias("alight")))
    one = one.withColumn("places", places).withColumn("pattern_id", F.xxhash64("feed_id", "route_id", "places"))
    one = cut(one.withColumn("dep0", F.col("rows")[0]["dep"]))  # read once for each of the three results
    patterns = one.groupBy("feed_id", "pattern_id", "route_id", "route_name", "agency").agg(
        F.min_by("headsign", F.struct("trip_id", "copy_no")).alias("headsign"), F.expr("mode(nullif(shape_id, ''), true)").alias("shape_id"), F.first("places").alias("places"))
    timed = first_per_key(one, ["pattern_id", "dep0"], ["trip_id", "copy_no"])
    timed = timed.withColumn("trip_no", F.row_number().over(W.partitionBy("pattern_id").orderBy("dep0")))
    times = timed.select("feed_id", "pattern_id", "trip_no", F.posexplode("rows").alias("pos", "r")).select("feed_id", "pattern_id", "trip_no", (F.col("pos") + 1).alias("pos"), "r.dep", "r.arr")
    stops = patterns.select("feed_id", "pattern_id", F.posexplode("places").alias("pos", "p")).select("feed_id", "pattern_id", (F.col("pos") + 1).alias("pos"), "p.stop_id", "p.board", "p.alight")
    return patterns.drop("places"), stops, times
