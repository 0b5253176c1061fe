"""Queries on routes, legs and itineraries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.functions.geo import MILE
from transit_spark.functions.text import chain_step_matches
from transit_spark.operators import chain, locality, replay, report, search
from transit_spark.plans import views as v
from transit_spark.plans.sql import EDGES, PLANE, STOPS, X


def _in_order(own: str = "l_orderkey") -> Column:
    return F.row_number().over(W.partitionBy(own).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


def route_feeds(s: SparkSession, d: str) -> DataFrame:
    """Feeds that serve orders as routes: brands of the parts ridden, nations of the zones taken."""
    li, part = v.table(s, d, "lineitem"), v.table(s, d, "part")
    zones = v.table(s, d, "supplier").join(v.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("zone_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise("layer").alias("source"))
    ids = part.select(F.col("p_brand").alias("feed_id")).unionByName(v.table(s, d, "nation").select(F.col("n_name").alias("feed_id"))).distinct()
    manifest = ids.select("feed_id", (F.length("feed_id") % 2 == 0).alias("stale"), F.lit("2026-05-31T00:00").alias("service_end"))
    legs = li.select(F.col("l_orderkey").alias("route_id"), F.when(F.col("l_returnflag") == "R", "flex").otherwise("ride").alias("kind"), F.col("l_suppkey").alias("zone_id"))
    options = li.select(F.col("l_orderkey").alias("route_id"), F.col("l_partkey").alias("pattern_id"))
    return report.route_feeds(legs, options, part.select(F.col("p_partkey").alias("pattern_id"), F.col("p_brand").alias("feed_id")), zones, manifest).select("route_id", "feed_id", "note")


def distinct_routes(s: SparkSession, d: str) -> DataFrame:
    """Orders as routes, one of those whose line items pass the same nodes."""
    kind = F.ascii("l_returnflag")
    legs = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("leg_no"), F.col("l_linenumber").alias("u"), kind.alias("v"))
    routes = v.table(s, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("rank"))
    return search.distinct_routes(routes, legs, ["query_id"], F.struct("rank", "query_id"))


def fastest_connections(s: SparkSession, d: str) -> DataFrame:
    dep = F.col("l_orderkey") % 86400
    return replay.fastest_connection(v.table(s, d, "lineitem").select(F.col("l_suppkey").alias("route_id"), dep.alias("dep"), (dep + F.col("l_partkey") * 13 % 5000).alias("arr")))


def itinerary_steps(s: SparkSession, d: str) -> DataFrame:
    """Waits and legs of the starts at 60 s."""
    done = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("leg_no"), (F.col("l_partkey") % 2 * 60).alias("t0"), F.when(F.col("l_returnflag") == "N", "ride").otherwise("walk").alias("kind"), (F.col("l_linenumber") * 600).cast("bigint").alias("wait_from"), (F.col("l_linenumber") * 600 + F.col("l_suppkey") % 4 * 60).cast("bigint").alias("dep"), (F.col("l_linenumber") * 600 + 500).cast("bigint").alias("arr"))
    return replay.itinerary_steps(done, 60)


def described_legs(s: SparkSession, d: str) -> DataFrame:
    """Line items as legs with the names of their ends, their departures and the bottleneck of their order."""
    li, t = v.table(s, d, "lineitem"), v.table(s, d, "supplier")
    legs = li.select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("leg_no"), F.col("l_suppkey").alias("u"), (F.col("l_partkey") % t.count() + 1).alias("v"), F.col("l_quantity").cast("double").alias("freq"))
    nodes = t.select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("name"), F.lit(40.0).alias("lat"), F.lit(-75.0).alias("lon"))
    stats = li.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("leg_no")).agg(F.count("*").alias("all_day"))
    out = report.describe_legs(legs, nodes, stats)
    return out.select("route_id", "leg_no", F.col("from")["name"].alias("origin"), F.col("to")["name"].alias("destination"), "bottleneck", "all_day")


def density_miles(s: SparkSession, d: str) -> DataFrame:
    """Miles by class of stop density up to each stop of an order as a pattern."""
    stops = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("pattern_id"), _in_order().alias("pos"), F.col("l_suppkey").alias("node"), (F.col("l_returnflag") != "R").alias("board"), (F.col("l_linenumber") != 2).alias("alight"))
    out = locality.stop_density_miles(stops, v.nodes(s, d))
    return out.select("pattern_id", "pos", *[F.round(F.col("miles")[k], 4).alias(f"miles_{k}") for k in range(3)])


def serving_trips(s: SparkSession, d: str) -> DataFrame:
    """Orders as trips that serve the legs from each supplier to the next."""
    t, li = v.table(s, d, "supplier"), v.table(s, d, "lineitem")
    legs = t.select(F.col("s_suppkey").alias("route_id"), F.lit(1).alias("leg_no"), F.col("s_suppkey").alias("u"), (F.col("s_suppkey") % t.count() + 1).alias("v"))
    rows = li.select(F.col("l_orderkey").alias("pattern_id"), _in_order().alias("pos"), F.col("l_suppkey").alias("node"), (F.col("l_returnflag") != "R").alias("board"), (F.col("l_linenumber") != 3).alias("alight"))
    times = rows.select("pattern_id", F.lit(1).alias("trip_no"), "pos", (F.col("pattern_id") % 80000 + F.col("pos") * 300).alias("dep"), (F.col("pattern_id") % 80000 + F.col("pos") * 300 - 20).alias("arr"))
    return replay.serving_options(legs, rows, times).select("route_id", "pattern_id", "dep", "arr")


def chain_links(s: SparkSession, d: str) -> DataFrame:
    """Transfers from customers of one segment, as stops of the first route, to those of another."""
    step = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    stops = v.table(s, d, "customer").select(step.alias("step"), F.col("c_custkey").alias("node"))
    return chain.chain_transfers(stops, v.nodes(s, d), 2000.0).where("step = 0").select("u", "v", F.round("dist", 4).alias("dist"))


def chain_steps(s: SparkSession, d: str) -> DataFrame:
    """Which customers' routes a step of a chain names."""
    name = F.concat((F.col("c_custkey") % 30).cast("string"), F.when(F.col("c_custkey") % 2 == 0, " Limited").otherwise(""))
    flag = lambda step: chain_step_matches(name, F.col("c_mktsegment"), step)
    return v.table(s, d, "customer").select("c_custkey", flag("7").alias("short"), flag("8 Limited").alias("whole"), flag("build:8").alias("agency"))


def feed_gaps(s: SparkSession, d: str) -> DataFrame:
    """Where the way from a customer of each nation to one of the next breaks: customers ride within their nation only; feeds are nine in number."""
    c = v.table(s, d, "customer")
    own = W.partitionBy("c_nationkey")
    placed = c.select("c_nationkey", F.col("c_custkey").alias("node"), (F.row_number().over(own.orderBy("c_custkey")) - 1).alias("i"), F.count("*").over(own).alias("n"))
    next_ = placed.withColumn("j", F.explode(F.array(F.col("i") * 2 % F.col("n"), (F.col("i") * 2 + 1) % F.col("n"))))
    rides = next_.join(placed.select("c_nationkey", F.col("i").alias("j"), F.col("node").alias("v")), ["c_nationkey", "j"]).select(F.col("node").alias("u"), "v", F.lit(1.0).alias("freq"))
    rides = rides.withColumns({"time": F.lit(60.0), "miles": F.array(F.lit(0.0)), "dist": F.lit(None).cast("double"), "zone_id": F.lit(None).cast("bigint")})
    nodes = v.nodes(s, d).withColumn("feed_id", F.col("node") % 9)
    first = placed.groupBy("c_nationkey").agg(F.min("node").alias("node"))
    asked = first.select(F.col("c_nationkey").alias("query_id"), F.col("node").alias("origin"), ((F.col("c_nationkey") + 1) % 25).alias("next")).join(first.select(F.col("c_nationkey").alias("next"), F.col("node").alias("destination")), "next").drop("next")
    out = search.gap_report(search.Network(rides, v.walks(s, d).where("false")), nodes, asked, 800.0)
    return out.select("query_id", "from_node", "to_node", "feed_a", "feed_b", F.round("dist", 2).alias("dist"))


QUERIES = {f.__name__: f for f in (route_feeds, distinct_routes, fastest_connections, itinerary_steps, described_legs, density_miles, serving_trips, chain_links, chain_steps, feed_gaps)}

ORDERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

SQL = {
    "route_feeds": """SELECT route_id, feed_id, CASE WHEN length(feed_id) % 2 = 0 THEN 'calendar ended 2026-05-31' END AS note FROM (SELECT l_orderkey AS route_id, p_brand AS feed_id FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION SELECT l_orderkey, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag = 'R' AND s_suppkey % 2 = 0)""",
    "distinct_routes": """WITH l AS (SELECT l_orderkey AS k, list((l_linenumber, l_returnflag) ORDER BY l_linenumber, l_returnflag) AS seq FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS query_id, o_custkey AS rank, row_number() OVER (PARTITION BY seq ORDER BY o_custkey, o_orderkey) AS n FROM orders JOIN l ON k = o_orderkey) SELECT query_id, rank FROM r WHERE n = 1""",
    "fastest_connections": """WITH r AS (SELECT l_suppkey AS route_id, l_orderkey % 86400 AS dep, l_partkey * 13 % 5000 AS duration FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY duration, dep) AS n FROM r) SELECT route_id, dep, dep + duration AS arr, duration FROM k WHERE n = 1""",
    "itinerary_steps": """WITH r AS (SELECT l_orderkey AS route_id, l_linenumber AS leg_no, CASE WHEN l_returnflag = 'N' THEN 'ride' ELSE 'walk' END AS kind, CAST(l_linenumber * 600 AS BIGINT) AS w, CAST(l_linenumber * 600 + l_suppkey % 4 * 60 AS BIGINT) AS dep FROM lineitem WHERE l_partkey % 2 = 1)
SELECT route_id, leg_no, 'wait' AS step, w AS begin, dep AS "end" FROM r WHERE dep > w UNION ALL SELECT route_id, leg_no, kind, dep, w + 500 FROM r""",
    "described_legs": """WITH c AS (SELECT l_orderkey AS r, l_linenumber AS n, count(*) AS all_day FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
SELECT l_orderkey AS route_id, l_linenumber AS leg_no, a.s_name AS origin, b.s_name AS destination, l_quantity = min(l_quantity) OVER (PARTITION BY l_orderkey) AS bottleneck, all_day
FROM lineitem LEFT JOIN supplier a ON a.s_suppkey = l_suppkey LEFT JOIN supplier b ON b.s_suppkey = l_partkey % (SELECT count(*) FROM supplier) + 1 LEFT JOIN c ON r = l_orderkey AND n = l_linenumber""",
    "density_miles": f"""WITH {STOPS}, {PLANE}, p AS (SELECT l_orderkey AS id, {ORDERED} AS pos, l_suppkey AS node, l_returnflag <> 'R' OR l_linenumber <> 2 AS served FROM lineitem), q AS (SELECT p.*, x, y FROM p JOIN plane USING (node)),
h AS (SELECT id, pos, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / {MILE!r} AS m, lag(x) OVER w IS NOT NULL AS ok FROM q WHERE served WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT id, pos, m, greatest(m, 0.001) AS floored, sum(greatest(m, 0.001)) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) - greatest(m, 0.001) / 2 AS mid FROM h WHERE ok),
c AS (SELECT id, pos, m, count(*) OVER w / sum(floored) OVER w AS density FROM g WINDOW w AS (PARTITION BY id ORDER BY mid RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING))
SELECT id AS pattern_id, CAST(pos AS INTEGER) AS pos, round(coalesce(sum(m) FILTER (density >= 4) OVER w, 0), 4) AS miles_0, round(coalesce(sum(m) FILTER (density >= 2 AND density < 4) OVER w, 0), 4) AS miles_1, round(coalesce(sum(m) FILTER (density < 2) OVER w, 0), 4) AS miles_2
FROM q LEFT JOIN c USING (id, pos) WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "serving_trips": f"""WITH p AS (SELECT l_orderkey AS id, {ORDERED} AS pos, l_suppkey AS node, l_returnflag <> 'R' AS board, l_linenumber <> 3 AS alight FROM lineitem),
b AS (SELECT a.node AS route_id, a.id, a.pos AS i, b.pos AS j, row_number() OVER (PARTITION BY a.node, a.id ORDER BY a.pos, b.pos) AS n FROM p a JOIN p b ON a.id = b.id AND a.pos < b.pos AND a.board AND b.alight AND b.node = a.node % (SELECT count(*) FROM supplier) + 1)
SELECT route_id, id AS pattern_id, id % 80000 + i * 300 AS dep, id % 80000 + j * 300 - 20 AS arr FROM b WHERE n = 1""",
    "chain_links": f"""WITH {STOPS}, {PLANE}, s AS (SELECT plane.*, c_mktsegment AS seg FROM plane JOIN customer ON c_custkey = node),
p AS (SELECT a.node AS u, b.node AS v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM s a JOIN s b ON a.seg = 'BUILDING' AND b.seg = 'MACHINERY') SELECT u, v, round(dist, 4) AS dist FROM p WHERE dist <= 2000""",
    "chain_steps": "SELECT c_custkey, c_custkey % 30 = 7 AS short, c_custkey % 30 = 8 AND c_custkey % 2 = 0 AS whole, c_custkey % 30 = 8 AND c_mktsegment ILIKE '%build%' AS agency FROM customer",
    "feed_gaps": f"""WITH RECURSIVE {STOPS}, {PLANE}, p AS (SELECT c_nationkey AS k, c_custkey AS node, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
e AS (SELECT a.node AS u, b.node AS v FROM p a JOIN p b ON a.k = b.k AND (b.i = a.i * 2 % a.n OR b.i = (a.i * 2 + 1) % a.n)),
q AS (SELECT DISTINCT a.k, a.first AS o, b.first AS d FROM p a JOIN p b ON b.k = (a.k + 1) % 25),
fore AS (SELECT k, o AS node FROM q UNION SELECT k, v FROM fore JOIN e ON u = node),
back AS (SELECT k, d AS node FROM q UNION SELECT k, u FROM back JOIN e ON v = node),
m AS (SELECT k, a.node AS from_node, b.node AS to_node, a.node % 9 AS feed_a, b.node % 9 AS feed_b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM fore JOIN plane a ON a.node = fore.node JOIN back USING (k) JOIN plane b ON b.node = back.node
  QUALIFY row_number() OVER (PARTITION BY k, a.node ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.node) = 1),
c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k, feed_a, feed_b ORDER BY dist, from_node, to_node) = 1)
SELECT k AS query_id, from_node, to_node, feed_a, feed_b, round(dist, 2) AS dist FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY c.dist, feed_a, feed_b) <= 8""",
}
