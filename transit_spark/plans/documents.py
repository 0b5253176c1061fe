"""Queries that write feeds, zones, timetables and route documents from the given tables and read them back."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.checkpoint import shared_folder
from transit_spark.operators import roads
from transit_spark.plans import queries as q
from transit_spark.plans import views as v
from transit_spark.plans.sql import SQL as OTHER
from transit_spark.sources import documents, gtfs


def unpacked_feeds(s: SparkSession, d: str) -> DataFrame:
    """Customers as stops in zips, a zip of 100 stops, with a byte order mark, blanks in the header and a column that nobody wants; unpacked in one pass."""
    key = F.col("c_custkey")
    rows = v.table(s, d, "customer").select(F.floor(key / 100).cast("string").alias("feed"), key.alias("k"), F.col("c_name").alias("name"), (40 + key % 100 / 1000).cast("string").alias("lat"))

    def pack(table: pa.Table) -> pa.Table:
        out, text = io.BytesIO(), io.StringIO()
        lines = csv.writer(text)
        lines.writerow([" stop_id", "color", "stop_lat ", "stop_name"])
        for k, name, lat in sorted(zip(*(table.column(c).to_pylist() for c in ("k", "name", "lat")), strict=True)):
            lines.writerow([k, "red", lat, f" {name}"])
        with zipfile.ZipFile(out, "w") as files:
            files.writestr("in/stops.txt", "\ufeff" + text.getvalue())
        return pa.table({"path": [f"x/{table.column('feed')[0].as_py()}.zip"], "content": pa.array([out.getvalue()], pa.binary())})

    zips = rows.groupBy("feed").applyInArrow(pack, "path string, content binary")
    columns = ["stop_id", "stop_name", "stop_lat", "stop_lon"]
    folder = shared_folder(s)
    gtfs.feed_rows(zips, {"stops": columns, "agency": ["agency_name"]}, ("stops",)).write.partitionBy("table").parquet(folder)
    return gtfs.read_unpacked(s, folder, "stops", {"stops": columns})


def zone_documents(s: SparkSession, d: str) -> DataFrame:
    """Zones of nations written as features and read again: points and hours."""
    folder = shared_folder(s)
    documents.write_zones(q._zones(s, d), folder)
    zones = documents.read_zones(s, folder, lines=True)
    hours = zones.select("zone_id", "name", F.size("rings").alias("rings"), F.size(F.col("rings")[0]).alias("points"), F.round(F.col("rings")[0][1]["lon"], 4).alias("lon"), F.explode("service").alias("day", "windows"))
    return hours.select("zone_id", "name", "rings", "points", "lon", "day", F.explode("windows").alias("w")).select("zone_id", "name", "rings", "points", "lon", "day", "w.start", "w.end", "w.headway")


def reused_timetables(s: SparkSession, d: str) -> DataFrame:
    """Orders as patterns of nations as feeds, compiled in two runs: the second has new data of every fifth feed and compiles only those."""
    own = v.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("feed_id"))
    orders = v.table(s, d, "orders").join(own, "o_custkey").select("feed_id", F.col("o_orderkey").alias("pattern_id"))
    stops = v.table(s, d, "lineitem").join(orders.withColumnRenamed("pattern_id", "l_orderkey"), "l_orderkey").select("feed_id", F.col("l_orderkey").alias("pattern_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("stop_id"))
    folder, fifth = shared_folder(s), F.col("n_nationkey") % 5 == 0
    n = v.table(s, d, "nation")
    feeds = lambda run: n.select(F.col("n_nationkey").cast("string").alias("feed_id"), F.when(fifth & F.lit(run > 1), "new").otherwise("old").alias("dataset_id"), F.lit("2026-09-30").alias("target"), F.date_sub(F.lit("2026-09-30").cast("date"), F.when(fifth & F.lit(run > 1), 7).otherwise(0)).alias("service_date"))
    for run in (1, 2):
        todo = gtfs.feeds_to_compile(s, feeds(run), folder)
        mine = lambda df: df.join(F.broadcast(todo.select("feed_id")), "feed_id", "left_semi")  # noqa: B023, E731
        gtfs.write_timetable(todo, mine(orders).withColumn("run", F.lit(run)), mine(stops), mine(stops).withColumn("trip_no", F.lit(1)), folder)
    rows = s.read.parquet(f"{folder}/patterns")
    return rows.groupBy(F.col("feed_id").cast("string").alias("feed_id"), F.col("service_date").cast("string").alias("service_date"), "run").agg(F.count("*").alias("patterns"))


def _route_sets(s: SparkSession, d: str) -> DataFrame:
    """query_id, rank, label, leg_no, kind, from, to, services, headway: the orders of a customer as the routes offered for one question, line items as legs."""
    li, o = v.table(s, d, "lineitem"), v.table(s, d, "orders")
    at = lambda k: F.struct(F.concat(F.lit("stop "), k.cast("string")).alias("name"), (k % 100 / 10).alias("lon"), (k % 50 / 10).alias("lat"))
    service = F.array(F.struct(F.col("l_returnflag").alias("agency"), F.col("l_linestatus").alias("route")), F.struct(F.lit("b").alias("agency"), F.lit("2").alias("route")))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    leg = (F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    return rows.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("label"), leg.alias("leg_no"), F.when(F.col("l_returnflag") == "A", "walk").otherwise("ride").alias("kind"), at(F.col("l_suppkey")).alias("from"), at(F.col("l_partkey")).alias("to"), service.alias("services"), F.col("l_quantity").cast("double").alias("headway"))


def route_features(s: SparkSession, d: str) -> DataFrame:
    """Feature collections of all customers' routes, read back feature by feature in their order."""
    kind = "type string, features array<struct<type string, geometry struct<type string, coordinates array<array<double>>>, properties struct<route_rank bigint, route_label string, kind string, `from` string, `to` string, services string, effective_headway_s double>>>"
    docs = documents.route_features(_route_sets(s, d)).select("query_id", F.from_json("value", kind).alias("doc"))
    rows = docs.select("query_id", F.posexplode("doc.features").alias("place", "f"))
    p = F.col("f.properties")
    return rows.select("query_id", "place", p["route_rank"].alias("rank"), p["kind"].alias("kind"), p["from"].alias("origin"), p["to"].alias("destination"), p["services"].alias("services"), p["effective_headway_s"].alias("headway"), F.round(F.col("f.geometry.coordinates")[1][0], 4).alias("lon"))


def route_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents of all customers' routes, read back route by route: legs, connections, their summary and feeds."""
    rows = _route_sets(s, d)
    routes = rows.groupBy("query_id", "rank", "label").agg(F.count("*").alias("boardings"))
    profile = rows.where("kind = 'ride'").select("query_id", "rank", (F.col("leg_no") % 86400).alias("dep"), (F.col("leg_no") % 86400 + F.col("headway") * 60).cast("bigint").alias("arr"))
    feeds = rows.select("query_id", "rank", F.col("from.name").alias("feed_id")).distinct()
    runs = v.table(s, d, "customer").select(F.col("c_custkey").alias("query_id"), F.array(F.lit(21600), F.lit(79200)).alias("window"), F.lit(800.0).alias("max_walk_m"), F.col("c_name").alias("walk_note"))
    docs = documents.route_documents(runs, routes, rows.select("query_id", "rank", "leg_no", "kind", F.col("from.name").alias("from"), "headway"), profile, feeds)
    kind = "window array<int>, walk_note string, routes array<struct<label string, boardings bigint, legs array<struct<kind string, `from` string>>, connections array<array<bigint>>, profile struct<connections bigint, min_duration_s bigint, median_duration_s bigint, max_duration_s bigint>, feeds array<string>>>"
    read = docs.select("query_id", F.from_json("value", kind).alias("doc")).select("query_id", "doc.walk_note", F.posexplode_outer("doc.routes").alias("place", "r"))
    return read.select("query_id", "walk_note", "place", "r.label", "r.boardings", F.array_join("r.legs.from", "|").alias("origins"), F.size("r.connections").cast("bigint").alias("connections"), F.col("r.profile.median_duration_s").alias("median"), F.col("r.feeds")[0].alias("first_feed"))


def lane_sources(s: SparkSession, d: str) -> DataFrame:
    """The share of ways by where their lanes come from."""
    out = roads.way_coverage(roads.impute_lanes(roads.bus_ways(v.ways(s, d))))
    return out.select("source", "ways", F.round("share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (unpacked_feeds, zone_documents, reused_timetables, route_features, route_documents, lane_sources)}

SETS = """l AS (SELECT o_custkey AS q, o_orderkey AS rank, o_orderpriority AS label, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS leg, CASE WHEN l_returnflag = 'A' THEN 'walk' ELSE 'ride' END AS kind, 'stop ' || l_suppkey AS origin, 'stop ' || l_partkey AS destination,
  l_returnflag || ' ' || l_linestatus || ', b 2' AS services, CAST(l_quantity AS DOUBLE) AS headway, l_partkey % 100 / 10 AS lon FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

SQL = {
    "unpacked_feeds": "SELECT CAST(c_custkey // 100 AS VARCHAR) AS feed_id, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS row_no, CAST(c_custkey AS VARCHAR) AS stop_id, c_name AS stop_name, CAST(CAST(40 + c_custkey % 100 / 1000 AS DOUBLE) AS VARCHAR) AS stop_lat, '' AS stop_lon FROM customer",
    "zone_documents": "SELECT CAST(n_nationkey AS VARCHAR) AS zone_id, n_name AS name, 1 AS rings, 4 AS points, round(-75 + n_nationkey // 5 / 10 + 0.08, 4) AS lon, CAST(day AS INTEGER) AS day, 21600 AS start, 64800 AS \"end\", CAST(NULL AS INTEGER) AS headway FROM nation, range(0, 7) t(day)",
    "reused_timetables": """SELECT CAST(c_nationkey AS VARCHAR) AS feed_id, CASE run WHEN 1 THEN '2026-09-30' ELSE '2026-09-23' END AS service_date, CAST(run AS INTEGER) AS run, count(*) AS patterns FROM orders JOIN customer ON c_custkey = o_custkey, range(1, 3) t(run)
WHERE run = 1 OR c_nationkey % 5 = 0 GROUP BY 1, 2, 3""",
    "lane_sources": f"SELECT source, count(*) AS ways, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({OTHER['imputed_lanes']}) GROUP BY source",
    "route_features": f"WITH {SETS} SELECT q AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY rank, leg) - 1 AS INTEGER) AS place, rank, kind, origin, destination, CASE WHEN kind = 'ride' THEN services END AS services, CASE WHEN kind = 'ride' THEN headway END AS headway, round(lon, 4) AS lon FROM l",
    "route_documents": f"""WITH {SETS}, r AS (SELECT q, rank, label, count(*) AS boardings, string_agg(origin, '|' ORDER BY leg) AS origins, count(*) FILTER (kind = 'ride') AS connections,
  CAST(floor(median(CASE WHEN kind = 'ride' THEN CAST(headway * 60 AS BIGINT) END)) AS BIGINT) AS median, min(origin) AS first_feed FROM l GROUP BY ALL)
SELECT c_custkey AS query_id, c_name AS walk_note, CAST(CASE WHEN rank IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY rank) - 1 END AS INTEGER) AS place, label, boardings, origins, connections, median, first_feed FROM customer LEFT JOIN r ON q = c_custkey""",
}
