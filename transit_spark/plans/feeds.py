"""Queries on catalogues, atlases and the raw tables of feeds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.operators import catalog, flex, timetable
from transit_spark.plans import views as v
from transit_spark.plans.sql import STOPS

AGENCIES = [r"^united", r"machinery r1$", r"furn"]


def r4(c: str) -> Column:
    return F.round(c, 4).alias(c.rpartition(".")[2])


def _box(south: Column, west: Column) -> Column:
    return F.struct(south.alias("south"), west.alias("west"), (south + 0.1).alias("north"), (west + 0.1).alias("east"))


def loaded_feeds(s: SparkSession, d: str) -> DataFrame:
    """Feeds of a manifest that a run reads."""
    key = F.col("c_custkey")
    end = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (key % 900).cast("int")), "yyyy-MM-dd")
    manifest = v.table(s, d, "customer").select(F.concat(F.lit("f"), key.cast("string")).alias("feed_id"), F.col("c_mktsegment").alias("provider"), F.when(key % 11 != 0, "feed.zip").alias("path"), F.when(key % 5 == 0, "atlas-extra").otherwise("catalog").alias("source"), end.alias("service_end"))
    return catalog.load_filter(manifest, "2026-09-30", ["f7"], 200, ["machin"]).select("feed_id", "source")


def allowed_patterns(s: SparkSession, d: str) -> DataFrame:
    """Patterns of customers' routes without the left-out feeds, agencies and routes."""
    feeds = v.table(s, d, "nation").select(F.col("n_nationkey").alias("feed_id"), F.col("n_name").alias("provider"))
    route = F.concat(F.lit("R"), (F.col("c_custkey") % 30).cast("string"))
    patterns = v.table(s, d, "customer").select(F.col("c_custkey").alias("pattern_id"), F.col("c_nationkey").alias("feed_id"), F.col("c_mktsegment").alias("agency"), route.alias("route_name"))
    return catalog.exclude_agencies(feeds, patterns, AGENCIES).select("pattern_id", "feed_id")


def feed_boxes(s: SparkSession, d: str) -> DataFrame:
    return catalog.feed_bbox(v.stops(s, d)).select("feed_id", *[r4(f"bbox.{c}") for c in ("south", "west", "north", "east")])


def atlas_records(s: SparkSession, d: str) -> DataFrame:
    """Feeds and operators' names of atlas files, one file a nation."""
    t = v.table(s, d, "supplier")
    n, key = t.count(), F.col("s_suppkey")
    name = lambda k: F.concat(F.lit("f-"), k.cast("string"))
    url = F.concat(F.lit("http://a/"), key.cast("string"))
    operators = F.when(key % 3 == 0, F.array(F.struct(F.concat(F.lit("own "), key.cast("string")).alias("name"))))
    feed = F.struct(name(key).alias("id"), F.when(key % 5 == 0, "gtfs-rt").otherwise("gtfs").alias("spec"), F.struct(url.alias("static_current"), F.when(key % 2 == 0, F.array(F.concat(url, F.lit("/old")))).alias("static_historic")).alias("urls"), operators.alias("operators"))
    operator = F.when(key % 4 == 1, F.struct(F.concat(F.lit("op "), key.cast("string")).alias("name"), F.array(F.struct(name(key * 3 % n + 1).alias("feed_onestop_id"))).alias("associated_feeds")))
    files = t.groupBy("s_nationkey").agg(F.collect_list(feed).alias("feeds"), F.collect_list(operator).alias("operators"))
    return catalog.flatten_atlas(files).select("onestop_id", "url", F.size("historic").cast("bigint").alias("historic"), F.array_join("operators", "|").alias("operators"))


def extra_feeds(s: SparkSession, d: str) -> DataFrame:
    """Atlas feeds asked for by name that no kept feed is."""
    named = lambda c: F.concat(F.lit("o-"), F.col(c).cast("string")).alias("onestop_id")
    kept = v.table(s, d, "customer").where("c_acctbal > 0").select(named("c_custkey"))
    return catalog.atlas_extras(v.table(s, d, "supplier").select(named("s_suppkey"), F.col("s_name").alias("name")), kept, [f"o-{k}" for k in range(1, 200)])


def united_candidates(s: SparkSession, d: str) -> DataFrame:
    """Feeds found by three searches, as the last search has them."""
    c = v.table(s, d, "customer")
    found = lambda df, key, note: df.select(F.col(key).alias("feed_id"), F.lit(note).alias("note"))
    return catalog.union_candidates(found(c.where("c_acctbal > 0"), "c_custkey", "a"), found(v.table(s, d, "orders").select("o_custkey").distinct(), "o_custkey", "b"), found(c.where("c_mktsegment = 'BUILDING'"), "c_custkey", "c"))


def fresh_copies(s: SparkSession, d: str) -> DataFrame:
    """For each customer's stale feed the first of its orders' copies that is current and lies in the same area."""
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    stale = v.table(s, d, "customer").select(key.alias("feed_id"), F.when(key % 6 != 0, _box(39.5 + key % 20 / 10, -76 + key % 30 / 10)).alias("bbox"))
    copies = v.table(s, d, "orders").select(F.col("o_custkey").alias("feed_id"), order.alias("order"), F.concat(F.lit("u"), order.cast("string")).alias("url"), F.col("o_orderpriority").alias("label"), (order % 2 == 0).alias("by_url"), F.lit("1990-01-01").alias("service_start"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("service_end"), F.when(order % 11 != 0, _box(39.5 + order % 20 / 10, -76 + order % 30 / 10)).alias("bbox"))
    return catalog.pick_fresh(stale, copies, "1996-01-01").select("feed_id", "url", "label", "service_end")


def _raw_times(s: SparkSession, d: str) -> DataFrame:
    """Line items as raw stop times: feeds are nations of suppliers, trips orders, stops suppliers."""
    own = v.table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("feed_id"))
    clock = lambda tail: F.concat((F.col("l_orderkey") % 26).cast("string"), F.lit(":"), F.lpad((F.col("l_linenumber") * 5).cast("string"), 2, "0"), F.lit(tail))
    return v.table(s, d, "lineitem").join(own, "l_suppkey").select(
        "feed_id", (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("row_no"), F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("trip_id"), F.concat(F.col("l_suppkey").cast("string"), F.lit(" ")).alias("stop_id"),
        F.when(F.col("l_partkey") % 19 == 0, "x").otherwise(F.col("l_linenumber").cast("string")).alias("stop_sequence"), F.when(F.col("l_linenumber") == 3, " 1").alias("pickup_type"), F.when(F.col("l_returnflag") == "R", "1 ").otherwise("").alias("drop_off_type"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(clock(":00")).alias("arrival_time"), F.when(F.col("l_returnflag") == "N", "soon").otherwise(clock(":30")).alias("departure_time"),
    )


def _raw_stops(s: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    lat = F.when(key % 13 == 0, "0").when(key % 17 == 0, "north").otherwise((40 + key % 50 / 100).cast("string"))
    return v.table(s, d, "supplier").select(F.col("s_nationkey").alias("feed_id"), key.alias("row_no"), F.concat(F.lit(" "), key.cast("string")).alias("stop_id"), F.col("s_name").alias("stop_name"), lat.alias("stop_lat"), F.lit(" -75.25").alias("stop_lon"))


def used_stops(s: SparkSession, d: str) -> DataFrame:
    return timetable.valid_stops(_raw_stops(s, d), _raw_times(s, d)).select("feed_id", "stop_id", "name", r4("lat"), r4("lon"))


def cleaned_times(s: SparkSession, d: str) -> DataFrame:
    """Usable stop times of orders that aren't partial, with the boarding flags."""
    raw = _raw_times(s, d)
    done = v.table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("trip_id"))
    trips = raw.select("feed_id", F.trim("trip_id").alias("trip_id")).join(done, "trip_id", "left_semi")
    return timetable.clean_stop_times(raw, trips, timetable.valid_stops(_raw_stops(s, d), raw))


def open_zones(s: SparkSession, d: str) -> DataFrame:
    """On-demand zones for everybody, by name and agency."""
    key = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Access-A-Ride", "ADA van", "Dial-a-Ride", "Senior bus", "mobility  link", "Canada line")]), (key % 6 + 1).cast("int"))
    zones = v.table(s, d, "supplier").select(key.alias("zone_id"), F.concat_ws(" ", "s_name", kind).alias("name"), F.when(key % 7 == 0, "Paratransit Co").alias("agency"))
    return flex.open_zones(zones).select("zone_id", "name")


def layer_zones(s: SparkSession, d: str) -> DataFrame:
    """The opening hours of the wanted zones of a map layer, by day of the week."""
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    weekday = F.concat((key % 6 + 5).cast("string"), F.lit("am-"), (key % 5 + 1).cast("string"), F.lit("pm"))
    features = v.table(s, d, "customer").select(key.alias("zone_id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name"), none.alias("agency"), F.array().alias("rings"), weekday.alias("weekday"), F.when(key % 2 == 0, "9am-12pm: every 30 min").alias("saturday"), F.lit("closed").alias("sunday"), F.lit("layer").alias("source"), none.alias("info_url"))
    out = flex.zones_from_layer(features, ["BUILDING", "MACHINERY"])
    return out.select("zone_id", F.explode("service").alias("day", "windows")).select("zone_id", "day", F.explode("windows").alias("w")).select("zone_id", "day", "w.start", "w.end", "w.headway")


def flex_zones(s: SparkSession, d: str) -> DataFrame:
    """Zones in which orders' trips pick up, with the first and last moment and the number of their windows."""
    own = v.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("feed_id"))
    rows = v.table(s, d, "orders").join(own, "o_custkey").withColumns({"trip_id": F.col("o_orderkey").cast("string"), "location_id": F.concat(F.lit("z"), F.col("o_custkey").cast("string")), "hour": F.col("o_orderkey") % 20 + 1})
    clock = lambda h: F.concat(h.cast("string"), F.lit(":00:00"))
    times = rows.select("feed_id", F.col("o_orderkey").alias("row_no"), "trip_id", "location_id", clock(F.col("hour")).alias("start_pickup_drop_off_window"), clock(F.col("hour") + F.col("o_orderkey") % 3 - 1).alias("end_pickup_drop_off_window"))
    trips = rows.select("feed_id", "trip_id", F.col("o_orderpriority").alias("route_id"))
    routes = trips.select("feed_id", "route_id").distinct().withColumns({"route_short_name": F.when(~F.col("route_id").startswith("1"), F.col("route_id")), "route_long_name": F.concat(F.lit("long "), "route_id"), "agency": F.concat(F.lit("agency "), F.col("feed_id").cast("string"))})
    places = rows.select("feed_id", "location_id", F.array().alias("rings")).distinct()
    out = flex.gtfs_flex_zones(times, trips, routes, places, "2026-09-30").withColumn("w", F.map_values("service")[0])
    return out.select("zone_id", "name", "agency", "source", F.size("w").cast("bigint").alias("windows"), F.array_min(F.transform("w", lambda x: x["start"])).alias("opens"), F.array_max(F.transform("w", lambda x: x["end"])).alias("closes"))


QUERIES = {f.__name__: f for f in (loaded_feeds, allowed_patterns, feed_boxes, atlas_records, extra_feeds, united_candidates, fresh_copies, used_stops, cleaned_times, open_zones, layer_zones, flex_zones)}

RAW = """raw AS (SELECT s_nationkey AS feed_id, l_orderkey AS trip, l_suppkey AS stop, l_linenumber AS seq, l_partkey * 1000000 + l_suppkey AS row_no, l_partkey % 19 <> 0 AS ok, l_returnflag AS flag,
  l_orderkey % 26 * 3600 + l_linenumber * 300 AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
good AS (SELECT s_nationkey AS feed_id, s_suppkey AS stop, s_name AS name, round(40 + s_suppkey % 50 / 100.0, 4)::DOUBLE AS lat FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0 AND s_suppkey IN (SELECT stop FROM raw))"""
AREA = "CAST(39.5 + CAST({0} % 20 AS DOUBLE) / 10 AS DOUBLE) AS {1}_s, CAST(-76 + CAST({0} % 30 AS DOUBLE) / 10 AS DOUBLE) AS {1}_w"

SQL = {
    "loaded_feeds": """SELECT 'f' || c_custkey AS feed_id, CASE WHEN c_custkey % 5 = 0 THEN 'atlas-extra' ELSE 'catalog' END AS source FROM customer
WHERE c_custkey % 11 <> 0 AND c_custkey <> 7 AND (c_custkey % 5 = 0 OR c_mktsegment NOT ILIKE '%machin%') AND 637 - c_custkey % 900 <= 200""",
    "allowed_patterns": """SELECT c_custkey AS pattern_id, c_nationkey AS feed_id FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE n_name NOT ILIKE 'united%' AND n_name NOT ILIKE '%furn%' AND c_mktsegment NOT ILIKE 'united%' AND c_mktsegment NOT ILIKE '%furn%' AND c_mktsegment || ' R' || c_custkey % 30 NOT ILIKE '%machinery r1'""",
    "feed_boxes": f"WITH {STOPS} SELECT feed_id, round(min(lat), 4)::DOUBLE AS south, round(min(lon), 4)::DOUBLE AS west, round(max(lat), 4)::DOUBLE AS north, round(max(lon), 4)::DOUBLE AS east FROM stops GROUP BY 1",
    "atlas_records": """WITH o AS (SELECT s_nationkey AS f, 'op ' || s_suppkey AS name, s_suppkey * 3 % (SELECT count(*) FROM supplier) + 1 AS feed FROM supplier WHERE s_suppkey % 4 = 1),
n AS (SELECT f, feed, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM o GROUP BY 1, 2), one AS (SELECT f, min(name) AS name FROM o GROUP BY 1 HAVING count(*) = 1)
SELECT 'f-' || s_suppkey AS onestop_id, 'http://a/' || s_suppkey AS url, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS historic,
  coalesce(nullif(concat_ws('|', CASE WHEN s_suppkey % 3 = 0 THEN 'own ' || s_suppkey END, names), ''), one.name, '') AS operators FROM supplier LEFT JOIN n ON feed = s_suppkey AND n.f = s_nationkey LEFT JOIN one ON one.f = s_nationkey WHERE s_suppkey % 5 <> 0""",
    "extra_feeds": "SELECT 'o-' || s_suppkey AS onestop_id, s_name AS name FROM supplier WHERE s_suppkey < 200 AND s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "united_candidates": """SELECT feed_id, max(note) AS note FROM (SELECT c_custkey AS feed_id, 'a' AS note FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 'b' FROM orders
  UNION ALL SELECT c_custkey, 'c' FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
    "fresh_copies": f"""WITH a AS (SELECT c_custkey AS feed_id, {AREA.format('c_custkey', 'a')} FROM customer), b AS (SELECT *, {AREA.format('o_orderkey', 'b')} FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01'),
k AS (SELECT feed_id, o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY feed_id ORDER BY o_orderkey) AS n FROM a JOIN b ON o_custkey = feed_id
  WHERE CASE WHEN feed_id % 6 = 0 THEN o_orderkey % 2 = 0 ELSE o_orderkey % 11 = 0 OR b_s <= a_s + 0.1::DOUBLE + 0.3::DOUBLE AND b_s + 0.1::DOUBLE >= a_s - 0.3::DOUBLE AND b_w <= a_w + 0.1::DOUBLE + 0.3::DOUBLE AND b_w + 0.1::DOUBLE >= a_w - 0.3::DOUBLE END)
SELECT feed_id, 'u' || o_orderkey AS url, o_orderpriority AS label, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS service_end FROM k WHERE n = 1""",
    "used_stops": f"WITH {RAW} SELECT feed_id, CAST(stop AS VARCHAR) AS stop_id, name, lat, -75.25::DOUBLE AS lon FROM good",
    "cleaned_times": f"""WITH {RAW} SELECT feed_id, CAST(trip AS VARCHAR) AS trip_id, CAST(row_number() OVER (PARTITION BY feed_id, trip ORDER BY seq, row_no) AS INTEGER) AS pos, CAST(stop AS VARCHAR) AS stop_id, seq <> 3 AS board, flag <> 'R' AS alight,
  CAST(CASE WHEN flag = 'A' THEN t + 30 ELSE t END AS INTEGER) AS arr, CAST(CASE WHEN flag = 'N' THEN t ELSE t + 30 END AS INTEGER) AS dep
FROM raw JOIN good USING (feed_id, stop) WHERE ok AND trip IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
    "open_zones": r"""WITH z AS (SELECT s_suppkey AS zone_id, s_name || ' ' || ['Access-A-Ride', 'ADA van', 'Dial-a-Ride', 'Senior bus', 'mobility  link', 'Canada line'][s_suppkey % 6 + 1] AS name FROM supplier)
SELECT zone_id, name FROM z WHERE zone_id % 7 <> 0 AND zone_id % 6 IN (2, 3, 5)""",
    "layer_zones": """WITH z AS (SELECT c_custkey AS zone_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT zone_id, CAST(g AS INTEGER) AS day, CAST((zone_id % 6 + 5) * 3600 AS INTEGER) AS start, CAST((zone_id % 5 + 13) * 3600 AS INTEGER) AS "end", CAST(NULL AS INTEGER) AS headway FROM z, generate_series(0, 4) t(g)
UNION ALL SELECT zone_id, 5, 32400, 43200, 1800 FROM z WHERE zone_id % 2 = 0""",
    "flex_zones": """WITH r AS (SELECT c_nationkey AS f, o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderpriority LIKE '1%' THEN 'long ' ELSE '' END || o_orderpriority AS route, (o_orderkey % 20 + 1) * 3600 AS a, (o_orderkey % 20 + o_orderkey % 3) * 3600 AS b FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT *, max(b) OVER (PARTITION BY f, c ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r)
SELECT f || '-z' || c AS zone_id, arg_min(route, k) AS name, 'agency ' || f AS agency, CAST(f AS VARCHAR) AS source, count(*) FILTER (reach IS NULL OR a > reach) AS windows, CAST(min(a) AS INTEGER) AS opens, CAST(max(b) AS INTEGER) AS closes FROM m GROUP BY f, c""",
}
