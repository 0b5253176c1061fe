"""DuckDB SQL with the rows of the queries, written on its own from what each job is to compute."""

from __future__ import annotations

import math

X = 6371000.0 * math.cos(math.radians(40.6))
STOPS = "stops AS (SELECT c_nationkey AS feed_id, c_custkey AS stop_id, 40 + (c_custkey * 7919 % 5000) / 10000.0 AS lat, -75 + (c_custkey * 104729 % 5000) / 10000.0 AS lon FROM customer)"
PLANE = f"plane AS (SELECT stop_id AS node, feed_id, radians(CAST(lon AS DOUBLE)) * {X!r} AS x, radians(CAST(lat AS DOUBLE)) * 6371000.0 AS y FROM stops)"
TIMES = """st0 AS (SELECT l_orderkey AS trip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  count(*) OVER (PARTITION BY l_orderkey) AS len, l_returnflag AS flag FROM lineitem),
sn AS (SELECT count(*) AS n FROM supplier),
st AS (SELECT trip, pos, len, trip % (2 * n) AS route, ((trip % (2 * n)) * 13 + pos * 7) % (n + 50) AS stop,
  CASE WHEN flag = 'N' AND pos > 1 AND pos < len THEN NULL ELSE (trip * 37 % 1440) * 60 + 300 * pos END AS t FROM st0, sn)"""
FILLED = TIMES + """,
fa AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
  first_value(CASE WHEN t IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb,
  last_value(t IGNORE NULLS) OVER (PARTITION BY trip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ta,
  first_value(t IGNORE NULLS) OVER (PARTITION BY trip ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM st),
filled AS (SELECT trip, pos, len, route, stop, CAST(round_even(ta + (tb - ta) * (pos - pa) / CAST(greatest(pb - pa, 1) AS DOUBLE), 0) AS INTEGER) AS t FROM fa)"""
WEEK = """week AS (SELECT s_nationkey AS feed_id, s_suppkey AS service_id, CAST(DATE '1995-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS DATE) AS a,
  CAST(DATE '1995-01-01' + CAST(s_suppkey % 300 + s_suppkey % 400 + 100 AS INTEGER) AS DATE) AS b, s_suppkey AS bits FROM supplier)"""
EXC = """exc AS (SELECT DISTINCT s_nationkey AS feed_id, s_suppkey AS service_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 2 END AS kind
  FROM orders JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier) + 1)"""
ON = "(bits // CAST(pow(2, isodow(d.date) - 1) AS BIGINT)) % 2 = 1"
RIDES = "rides AS (SELECT l_suppkey AS u, l_partkey % (SELECT count(*) FROM supplier) + 1 AS v, CAST(l_quantity AS DOUBLE) AS freq FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier) + 1)"
WALKS = "walks AS (SELECT s_suppkey AS u, s_suppkey % (SELECT count(*) FROM supplier) + 1 AS v, s_suppkey * 37 % 900 + 50 AS dist FROM supplier)"
EDGES = f"{RIDES}, {WALKS}, edges AS (SELECT u, v, max(freq) AS freq, CAST(NULL AS BIGINT) AS dist FROM rides GROUP BY u, v UNION ALL SELECT u, v, CAST(NULL AS DOUBLE), dist FROM walks WHERE dist <= 800)"


def rounds(name: str, first: str, step: str, n: int) -> str:
    """CTEs name0 (``first``), name1, ... of n rounds in which ``step`` (of the one before, named {s}) may lower the labels."""
    parts = [f"{name}0 AS MATERIALIZED ({first})"]
    return ",\n".join(parts + [f"{name}{i + 1} AS MATERIALIZED ({step.format(s=f'{name}{i}')})" for i in range(n)])


SPINE = [(40.0, -75.0), (40.2, -74.8), (40.5, -74.6)]
CATALOG = """cat AS (SELECT c_custkey AS feed_id, ['active', 'inactive', 'deprecated', 'future'][c_custkey % 4 + 1] AS status, c_custkey % 9 = 0 AS bare, c_custkey % 200 AS name,
  CAST(DATE '2025-01-01' + CAST(c_custkey % 900 AS INTEGER) AS DATE) AS until FROM customer)"""


def frequency(source: str, key: str, dep: str) -> str:
    return f"""w AS (SELECT {key} AS key, CASE WHEN {dep} >= 21600 AND {dep} < 79200 THEN CAST({dep} AS DOUBLE) END AS d FROM {source}),
g AS (SELECT key, d, lead(d) OVER (PARTITION BY key ORDER BY d NULLS LAST) - d AS gap FROM w),
f AS (SELECT key, CASE WHEN count(d) > 0 THEN 57600.0 * 57600.0 / greatest(coalesce(sum(gap * gap), 0) + pow((79200 - max(d)) + (min(d) - 21600), 2), 1) ELSE 0 END AS freq FROM g GROUP BY key)"""


def _spine(x: str, y: str) -> str:
    points = [(math.radians(lon) * X, math.radians(lat) * 6371000.0) for lat, lon in SPINE]
    out = []
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        dx, dy = x1 - x0, y1 - y0
        t = f"greatest(0, least(1, (({x} - {x0!r}) * {dx!r} + ({y} - {y0!r}) * {dy!r}) / {dx * dx + dy * dy!r}))"
        out.append(f"sqrt(pow({x} - {x0!r} - {t} * {dx!r}, 2) + pow({y} - {y0!r} - {t} * {dy!r}, 2))")
    return f"least({', '.join(out)})"


def _events(key: str) -> str:
    return f"WITH e AS (SELECT {key} AS k, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS dep FROM events), {frequency('e', 'k', 'dep')} SELECT key, round(freq, 4) AS freq FROM f"


def _smooth() -> str:
    out = """WITH p0 AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n,
  CAST(l_linenumber % 4 - 1 AS INTEGER) AS cls, CAST(l_quantity * 4 AS DOUBLE) AS len FROM lineitem),
q0 AS (SELECT k, n, len, coalesce(last_value(CASE WHEN cls >= 0 THEN cls END IGNORE NULLS) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(CASE WHEN cls >= 0 THEN cls END IGNORE NULLS) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), cls) AS cls FROM p0)"""
    for i in range(4):
        out += f""",
a{i} AS (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY k ORDER BY n) = cls THEN 0 ELSE 1 END AS new FROM q{i}),
b{i} AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM a{i}),
r{i} AS (SELECT k, run, min(cls) AS cls, sum(len) AS len FROM b{i} GROUP BY k, run),
s{i} AS (SELECT k, run, len, lag(cls) OVER (PARTITION BY k ORDER BY run) AS before, lead(cls) OVER (PARTITION BY k ORDER BY run) AS after FROM r{i}),
q{i + 1} AS (SELECT b.k, b.n, b.len, CASE WHEN s.len < 150 AND s.before = s.after THEN s.before ELSE b.cls END AS cls FROM b{i} b JOIN s{i} s USING (k, run))"""
    return out + " SELECT k AS l_suppkey, n AS piece_no, cls FROM q4"


SQL = {
    "effective_frequency_users": _events("user_id"),
    "effective_frequency_types": _events("event_type"),
    "interpolated_times": f"WITH {FILLED} SELECT trip, pos, t AS arr, t + 20 AS dep FROM filled".replace("t AS arr, t + 20 AS dep", "CAST(t AS INTEGER) AS arr, CAST(t + 20 AS INTEGER) AS dep"),
    "services_on_dates": f"""WITH {WEEK}, {EXC}, d AS (SELECT feed_id, CAST(g AS DATE) AS date FROM (SELECT DISTINCT feed_id FROM week), generate_series(DATE '1995-06-05', DATE '1995-06-18', INTERVAL 1 DAY) t(g))
SELECT feed_id, date, service_id FROM (SELECT d.feed_id, d.date, service_id FROM d JOIN week USING (feed_id) WHERE d.date BETWEEN a AND b AND {ON}
  UNION SELECT d.feed_id, d.date, service_id FROM d JOIN exc USING (feed_id, date) WHERE kind = 1
  EXCEPT SELECT feed_id, date, service_id FROM exc WHERE kind = 2)""",
    "calendar_ranges": f"WITH {WEEK}, {EXC} SELECT feed_id, min(a) AS lo, max(b) AS hi FROM (SELECT feed_id, a, b FROM week UNION ALL SELECT feed_id, date, date FROM exc WHERE kind = 1) GROUP BY feed_id",
    "service_dates": f"""WITH {WEEK}, {EXC}, r AS (SELECT feed_id, min(a) AS lo, max(b) AS hi FROM (SELECT feed_id, a, b FROM week UNION ALL SELECT feed_id, date, date FROM exc WHERE kind = 1) GROUP BY feed_id),
k AS (SELECT feed_id, CAST(ceil((lo - DATE '1995-09-06') / 7.0) AS INTEGER) AS k0, CAST(floor((hi - DATE '1995-09-06') / 7.0) AS INTEGER) AS k1 FROM r),
c AS (SELECT feed_id, unnest(range(greatest(k0, greatest(k0, least(k1, 0)) - 8), least(k1, greatest(k0, least(k1, 0)) + 8) + 1)) AS k FROM k WHERE k0 <= k1),
d AS (SELECT feed_id, place, CAST(DATE '1995-09-06' + CAST(7 * k AS INTEGER) AS DATE) AS date FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY abs(k), k) AS place FROM c) WHERE place <= 8),
runs AS (SELECT d.feed_id, d.date, service_id FROM d JOIN week USING (feed_id) WHERE d.date BETWEEN a AND b AND {ON}
  UNION SELECT d.feed_id, d.date, service_id FROM d JOIN exc USING (feed_id, date) WHERE kind = 1 EXCEPT SELECT feed_id, date, service_id FROM exc WHERE kind = 2),
trips AS (SELECT l_suppkey AS service_id, count(*) AS n FROM lineitem GROUP BY 1),
n AS (SELECT d.feed_id, d.place, d.date, coalesce(sum(trips.n), 0) AS n FROM d LEFT JOIN runs ON runs.feed_id = d.feed_id AND runs.date = d.date LEFT JOIN trips USING (service_id) GROUP BY 1, 2, 3),
m AS (SELECT *, max(n) OVER (PARTITION BY feed_id) AS most FROM n)
SELECT feed_id, arg_min(date, place) AS service_date, arg_min(date, place) <> DATE '1995-09-06' AS moved FROM m WHERE most > 0 AND n >= 0.8 * most GROUP BY feed_id""",
    "compiled_patterns": f"""WITH {FILLED}, one AS (SELECT route, trip, list((pos, stop, pos % 7 <> 3) ORDER BY pos) AS seq, arg_min(t, pos) AS dep0 FROM filled GROUP BY route, trip HAVING count(*) >= 2),
m AS (SELECT route, seq, 's' || min(CASE WHEN n = top THEN shape END) AS shape_id FROM (SELECT route, seq, shape, n, max(n) OVER (PARTITION BY route, seq) AS top
  FROM (SELECT route, seq, trip % 3 AS shape, count(*) AS n FROM one GROUP BY ALL)) GROUP BY route, seq)
SELECT route AS route_id, CAST(len(one.seq) AS BIGINT) AS stops, count(DISTINCT dep0) AS trips, CAST(min(dep0) AS INTEGER) AS first_dep, 'to ' || arg_min(trip % 5, trip) AS headsign, any_value(m.shape_id) AS shape_id
FROM one JOIN m USING (route, seq) GROUP BY route, one.seq""",
    "running_profiles": f"""WITH {TIMES}, r AS (SELECT route, trip, pos, t AS dep, t - trip % 60 AS arr, max(CASE WHEN t >= 21600 AND t < 79200 THEN 1 ELSE 0 END) OVER (PARTITION BY route, trip) AS ok,
  first_value(t) OVER (PARTITION BY route, trip ORDER BY pos) AS dep0 FROM st WHERE t IS NOT NULL)
SELECT route AS pattern_id, CAST(pos AS INTEGER) AS pos, CAST(median(dep - dep0) AS DOUBLE) AS dep_med, CAST(median(arr - dep0) AS DOUBLE) AS arr_med FROM r WHERE ok = 1 GROUP BY route, pos""",
    "merged_nodes": "SELECT c_custkey % 400 AS stop_id, round(40 + c_custkey % 40 / 100.0, 4)::DOUBLE AS lat, round(-75 + c_custkey % 4 / 100.0, 4)::DOUBLE AS lon, min(c_nationkey) AS feed_id FROM customer GROUP BY 1, 2, 3",
    "pooled_edges": f"""WITH {FILLED}, one AS (SELECT route, trip, list((pos, stop) ORDER BY pos) AS seq, arg_min(t, pos) AS dep0 FROM filled GROUP BY route, trip HAVING count(*) >= 2),
ids AS (SELECT route, seq, row_number() OVER () AS id FROM (SELECT DISTINCT route, seq FROM one)),
pick AS (SELECT id, dep0, min(trip) AS trip FROM one JOIN ids USING (route, seq) GROUP BY id, dep0),
times AS (SELECT pick.id, pick.trip, f.pos, f.stop, f.t, pick.dep0, max(CASE WHEN f.t >= 21600 AND f.t < 79200 THEN 1 ELSE 0 END) OVER (PARTITION BY pick.id, pick.trip) AS ok FROM pick JOIN filled f USING (trip)),
{frequency('times', '(id, pos)', 't')},
prof AS (SELECT id, pos, any_value(stop) AS stop, median(t - dep0) AS med FROM times WHERE ok = 1 GROUP BY id, pos),
p AS (SELECT prof.*, f.freq FROM prof JOIN f ON f.key = (prof.id, prof.pos)),
pairs AS (SELECT a.stop AS u, b.stop AS v, a.freq, CAST(greatest(b.med - a.med, 30) AS DOUBLE) AS time,
  list_transform([0, 1, 2], lambda k: CASE WHEN b.stop % 3 >= k THEN b.pos * 0.5 ELSE 0 END - CASE WHEN a.stop % 3 >= k THEN a.pos * 0.5 ELSE 0 END) AS m
  FROM p a JOIN p b ON a.id = b.id AND a.pos < b.pos AND a.stop <> b.stop AND a.freq > 0 AND b.pos % 7 <> 3)
SELECT u, v, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS cls, round(sum(freq), 4) AS freq, round(sum(time * freq) / sum(freq), 4) AS time FROM pairs GROUP BY 1, 2, 3""",
    "stop_density": """WITH h AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos, greatest(CAST(l_quantity AS DOUBLE) / 64, 0.001) AS miles FROM lineitem),
m AS (SELECT *, sum(miles) OVER (PARTITION BY l_suppkey ORDER BY pos ROWS UNBOUNDED PRECEDING) - miles / 2 AS mid FROM h),
c AS (SELECT *, count(*) OVER w / sum(miles) OVER w AS density FROM m WINDOW w AS (PARTITION BY l_suppkey ORDER BY mid RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING))
SELECT l_suppkey, CASE WHEN density >= 4 THEN 0 WHEN density >= 2 THEN 1 ELSE 2 END AS cls, count(*) AS hops, round(sum(miles), 4) AS miles FROM c GROUP BY 1, 2""",
    "near_walks": f"WITH {STOPS}, {PLANE}, p AS (SELECT a.node AS u, b.node AS v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM plane a JOIN plane b ON a.node <> b.node) SELECT u, v, round(dist, 4) AS dist FROM p WHERE dist <= 2000",
    "gap_walks": f"""WITH {STOPS}, {PLANE}, p AS (SELECT a.node AS u, b.node AS v, b.feed_id AS f, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM plane a JOIN plane b ON a.feed_id <> b.feed_id),
r AS (SELECT *, row_number() OVER (PARTITION BY u, f ORDER BY dist, v) AS rank FROM p),
k AS (SELECT u, v, dist FROM r WHERE (rank <= 3 AND dist > 400 AND dist <= 2500) OR (rank = 1 AND dist > 400 AND dist < 8000))
SELECT u, v, round(dist, 4) AS dist FROM (SELECT u, v, dist FROM k UNION SELECT v, u, dist FROM k)""",
    "place_access": f"""WITH {STOPS}, {PLANE}, q AS (SELECT -s_suppkey AS place, s_suppkey % 2 = 0 AS origin, radians(CAST(-75 + (s_suppkey * 104729 % 5000) / 10000.0 + 0.001 AS DOUBLE)) * {X!r} AS x, radians(CAST(40 + (s_suppkey * 7919 % 5000) / 10000.0 AS DOUBLE)) * 6371000.0 AS y FROM supplier),
p AS (SELECT place, node, origin, sqrt(pow(q.x - plane.x, 2) + pow(q.y - plane.y, 2)) AS dist FROM q, plane)
SELECT CASE WHEN origin THEN place ELSE node END AS u, CASE WHEN origin THEN node ELSE place END AS v, round(greatest(dist * 1.3 / 1.25, 1), 4) AS time, round(dist, 4) AS dist FROM p WHERE dist <= 800""",
    "scalar_functions": """WITH o AS (SELECT *, o_custkey % 30 * 3600 + o_orderkey % 60 * 60 + 7 AS s FROM orders)
SELECT o_orderkey, o_custkey, CAST(s AS INTEGER) AS seconds, printf('%02d:%02d', s % 86400 // 3600, s % 3600 // 60) || CASE WHEN s >= 86400 THEN ' (+1d)' ELSE '' END AS clock,
  CASE WHEN o_custkey * 7 >= 3600 THEN printf('%dh%02dm', o_custkey * 7 // 3600, o_custkey * 7 % 3600 // 60) ELSE printf('%dm', o_custkey * 7 // 60) END AS duration, CAST(o_orderdate AS DATE) AS day,
  CAST(CAST(o_orderdate AS DATE) + CAST((o_custkey % 7 - (isodow(o_orderdate) - 1) + 7) % 7 AS INTEGER) AS DATE) AS next_day,
  trim(regexp_replace(lower(o_orderpriority) || ' bus co', '[^a-z0-9]+', ' ', 'g')) AS name, 'example.com/' || lower(o_orderpriority) AS url FROM o""",
    "page_addresses": "SELECT page_id, rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/') AS at FROM pages",
    "opening_hours": 'SELECT c_custkey, CAST((c_custkey % 11 + 1) * 3600 + 1800 AS INTEGER) AS start, CAST((c_custkey % 9 + 13) * 3600 AS INTEGER) AS "end", CASE WHEN c_custkey % 2 = 0 THEN 5400 END AS headway FROM customer',
    "planar_distances": f"""WITH {STOPS}, {PLANE} SELECT s.stop_id, round(x, 2) AS x, round(y, 2) AS y, round({_spine('x', 'y')}, 2) AS spine,
  round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(40.0 - CAST(lat AS DOUBLE)) / 2), 2) + cos(radians(40.0)) * cos(radians(CAST(lat AS DOUBLE))) * pow(sin(radians(-75.0 - CAST(lon AS DOUBLE)) / 2), 2))), 2) AS great_circle FROM plane JOIN stops s ON s.stop_id = node""",
    "corridor_feeds": f"WITH {STOPS}, {PLANE} SELECT node % 300 AS feed_id FROM plane GROUP BY 1 HAVING min({_spine('x', 'y')}) <= 2000",
    "way_lanes": """WITH w AS (SELECT p_partkey AS id, p_size AS size, ['motorway', 'trunk', 'primary', 'secondary', 'residential', 'footway'][p_size % 6 + 1] AS h, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 + 1 END AS n, p_partkey % 4 = 0 AS one FROM part)
SELECT id AS way_id, CAST(one AS INTEGER) AS oneway, CAST(CASE WHEN one THEN n ELSE greatest(n // 2, CASE WHEN n IS NOT NULL THEN 1 END) END AS DOUBLE) AS fwd,
  CAST(CASE WHEN one THEN 1 ELSE greatest(n // 2, CASE WHEN n IS NOT NULL THEN 1 END) END AS DOUBLE) AS bwd, h = 'motorway' AS controlled, id % 7 = 0 AS off_grade,
  CAST(CASE WHEN h = 'motorway' THEN 3 WHEN n IS NULL THEN NULL WHEN CASE WHEN one THEN n ELSE greatest(n // 2, 1) END < 2 THEN 0 WHEN CASE WHEN one THEN n ELSE greatest(n // 2, 1) END < 3 THEN 1 ELSE 2 END AS INTEGER) AS cls FROM w""",
    "resampled_shapes": f"""WITH s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
  radians(CAST(-75 + (l_suppkey * 104729 % 50) / 10000.0 AS DOUBLE)) * {X!r} AS x, radians(CAST(40.6 + (l_partkey * 7919 % 50) / 10000.0 AS DOUBLE)) * 6371000.0 AS y FROM lineitem),
d AS (SELECT id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM s WINDOW w AS (PARTITION BY id ORDER BY n)),
t AS (SELECT id, sum(d) AS m FROM d WHERE d > 0.01 GROUP BY id) SELECT id AS shape_id, CAST(greatest(ceil(m / 100 - 1e-9), 1) AS BIGINT) AS pieces, round(m, 2) AS metres FROM t""",
    "smoothed_classes": _smooth(),
    "united_windows": """WITH r AS (SELECT DISTINCT user_id AS key, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS a FROM events),
n AS (SELECT *, CASE WHEN lag(a) OVER (PARTITION BY key ORDER BY a) + 600 >= a THEN 0 ELSE 1 END AS new FROM r), g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT key, CAST(min(a) AS INTEGER) AS start, CAST(max(a) + 600 AS INTEGER) AS "end", CAST(min(a) % 7 AS INTEGER) AS headway FROM g GROUP BY key, island""",
    "zone_stops": f"""WITH {STOPS}, {PLANE}, z AS (SELECT n_nationkey AS id, 40 + n_nationkey % 5 / 10.0 AS lat, -75 + n_nationkey // 5 / 10.0 AS lon FROM nation),
c AS (SELECT id, i, lat + [0, 0, 0.06, 0.05][i] AS lat, lon + [0, 0.08, 0.09, 0.01][i] AS lon FROM z, generate_series(1, 4) t(i)),
e AS (SELECT a.id, radians(CAST(a.lon AS DOUBLE)) * {X!r} AS x0, radians(CAST(a.lat AS DOUBLE)) * 6371000.0 AS y0, radians(CAST(b.lon AS DOUBLE)) * {X!r} AS x1, radians(CAST(b.lat AS DOUBLE)) * 6371000.0 AS y1 FROM c a JOIN c b ON a.id = b.id AND b.i = a.i % 4 + 1)
SELECT id AS zone_id, node FROM e, plane WHERE (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
    "reachable_suppliers": f"""WITH RECURSIVE {EDGES}, reach AS (SELECT n_nationkey AS q, n_nationkey + 1 AS node, 0 AS layer FROM nation
UNION SELECT q, e.v, CASE WHEN e.dist IS NULL THEN 0 ELSE CAST(ceil((layer * 400 + e.dist) / 400.0) AS INTEGER) END FROM reach JOIN edges e ON e.u = node WHERE e.freq >= 50 OR layer * 400 + e.dist <= 800)
SELECT q AS query_id, count(*) AS nodes, CAST(sum(node) AS BIGINT) AS node_sum FROM (SELECT DISTINCT q, node FROM reach) GROUP BY q""",
    "widest_paths": f"""WITH RECURSIVE {EDGES}, reach AS (SELECT n_nationkey + 1 AS o, n_nationkey + 1 AS node, 0 AS layer, 1e9 AS label FROM nation
UNION SELECT o, e.v, CASE WHEN e.dist IS NULL THEN 0 ELSE CAST(ceil((layer * 400 + e.dist) / 400.0) AS INTEGER) END, least(label, coalesce(e.freq, 1e9)) FROM reach JOIN edges e ON e.u = node WHERE e.dist IS NULL OR layer * 400 + e.dist <= 800)
SELECT o AS origin, node, CASE WHEN max(label) = 1e9 THEN -1 ELSE max(label) END AS freq FROM reach GROUP BY 1, 2""",
    "best_routes": f"""WITH n AS (SELECT count(*) AS n FROM supplier), {WALKS},
r AS MATERIALIZED (SELECT u, v, min(c) AS c, -min((c, -f))[2] AS f FROM (SELECT l_suppkey AS u, l_partkey % n + 1 AS v, CAST(l_quantity AS DOUBLE) AS f,
  60 + l_partkey % 600 + 0.5 * 57600 / CAST(l_quantity AS DOUBLE) + 300 + l_partkey % 10 / 4 * CASE l_linenumber % 3 WHEN 1 THEN 60 WHEN 2 THEN 180 ELSE 0 END AS c FROM lineitem, n) WHERE u <> v AND f >= 45 GROUP BY u, v),
q AS (SELECT n_nationkey AS q, n_nationkey + 1 AS o, n_nationkey * 31 % n + 1 AS d FROM nation, n WHERE n_nationkey + 1 <> n_nationkey * 31 % n + 1),
{rounds("s", "SELECT q, o AS node, 0 AS layer, CAST(0 AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS f FROM q", """SELECT q, node, layer, min(c) AS c, arg_min_null(f, c) AS f FROM (SELECT * FROM {s}
  UNION ALL SELECT q, r.v, 0, s.c + r.c + 1e-3, least(s.f, r.f) FROM {s} s JOIN r ON r.u = s.node
  UNION ALL SELECT q, w.v, CAST(ceil((layer * 400 + dist) / 400.0) AS INTEGER), s.c + greatest(dist * 1.04 * (1.5 + 1.5 * (1 - least(greatest(1000 - layer * 400, 0), dist) / dist)), 1), s.f
    FROM {s} s JOIN walks w ON w.u = s.node WHERE layer * 400 + dist <= 800) GROUP BY q, node, layer""", 12)}
SELECT q AS query_id, round(min(c), 2) AS cost, arg_min_null(f, c) AS bottleneck FROM s12 JOIN q USING (q) WHERE node = d GROUP BY q""",
    "required_walks": """WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier),
k AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey * 37 % 300 ELSE s_suppkey * 37 % 900 END + 50 + s_suppkey / 7 AS d, s_suppkey % 3 = 0 AS ride FROM supplier),
q AS (SELECT n_nationkey AS q, n_nationkey * 7 % n AS o FROM nation, n),
c AS (SELECT CAST(800 AS DOUBLE) AS m UNION SELECT d FROM k WHERE NOT ride AND d > 800),
w AS (SELECT q, o, m, 0 AS i, 0 AS layer FROM q, c
  UNION ALL SELECT q, o, m, i + 1, CASE WHEN ride THEN 0 ELSE CAST(ceil((layer * 400 + d) / 400) AS INTEGER) END FROM w, n JOIN k ON k.s = (o + i) % n + 1 WHERE i < 7 AND (ride OR layer * 400 + d <= m))
SELECT q AS query_id, round(min(m), 6) AS max_walk FROM w WHERE i = 7 GROUP BY q""",
    "evaluated_chains": f"""WITH n AS (SELECT count(*) AS n FROM supplier),
g AS (SELECT s_suppkey AS node, radians(CAST(-75 + s_suppkey * 104729 % 5000 / 10000.0 AS DOUBLE)) * {X!r} AS x, radians(CAST(40 + s_suppkey * 7919 % 5000 / 10000.0 AS DOUBLE)) * 6371000.0 AS y FROM supplier),
near AS (SELECT a.node AS u, b.node AS v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM g a JOIN g b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 800),
foot AS (SELECT u, v, greatest(greatest(d * 1.04, 1) * 1.5, 1) AS c FROM near),
t AS (SELECT l_orderkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_suppkey AS node, l_linenumber % 5 <> 4 AS board, l_linenumber % 3 <> 2 AS alight, CAST(l_partkey % 16 + 1 AS DOUBLE) AS f FROM lineitem),
pr AS (SELECT a.p, a.node AS u, b.node AS v, a.f, greatest(b.i * 300 - 20 - a.i * 300, 30) AS t, b.i - a.i AS hops FROM t a JOIN t b ON a.p = b.p AND a.i < b.i AND a.board AND b.alight AND a.node <> b.node),
o AS (SELECT o_orderkey AS p, CAST(o_custkey % 30 AS VARCHAR) || CASE WHEN o_custkey % 2 = 0 THEN ' Limited' ELSE '' END AS name, o_orderpriority AS agency FROM orders),
st AS (SELECT n_nationkey AS k, 0 AS step, CAST(n_nationkey % 30 AS VARCHAR) AS route, CASE WHEN n_nationkey % 4 = 0 THEN 'urgent|high' END AS agency FROM nation
  UNION ALL SELECT n_nationkey, 1, CAST(n_nationkey * 7 % 60 AS VARCHAR) || ' Limited', NULL FROM nation),
m AS (SELECT DISTINCT k, step, o.p FROM st JOIN o ON (o.name = st.route OR starts_with(o.name, st.route || ' ')) AND (st.agency IS NULL OR regexp_matches(o.agency, st.agency, 'i')) WHERE o.p IN (SELECT p FROM pr)),
stops AS (SELECT DISTINCT k, step, node FROM m JOIN t USING (p)),
e AS MATERIALIZED (SELECT k, step, u, v, sum(f * t) / sum(f) + 0.5 * 57600 / round_even(sum(f), 2) + 300 + sum(f * hops * 0.5) / sum(f) * 180 AS c FROM m JOIN pr USING (p) GROUP BY ALL),
pl AS (SELECT n_nationkey AS k, n_nationkey % n + 1 AS a, n_nationkey * 31 % n + 1 AS z FROM nation, n),
{rounds("s", "SELECT k, v AS node, c FROM pl JOIN foot ON u = a JOIN stops USING (k) WHERE step = 0 AND node = v", "SELECT k, node, min(c) AS c FROM (SELECT * FROM {s} UNION ALL SELECT k, e.v, s.c + e.c FROM {s} s JOIN e USING (k) WHERE e.step = 0 AND e.u = s.node) GROUP BY ALL", 6)},
{rounds("b", "SELECT k, f.v AS node, min(s.c + f.c) AS c FROM s6 s JOIN foot f ON f.u = s.node JOIN stops USING (k) WHERE stops.step = 1 AND stops.node = f.v GROUP BY ALL", "SELECT k, node, min(c) AS c FROM (SELECT * FROM {s} UNION ALL SELECT k, e.v, s.c + e.c FROM {s} s JOIN e USING (k) WHERE e.step = 1 AND e.u = s.node) GROUP BY ALL", 6)},
done AS (SELECT k, min(b.c + f.c) AS c FROM b6 b JOIN pl USING (k) JOIN foot f ON f.u = b.node AND f.v = z GROUP BY k),
missing AS (SELECT k, 'no service found for route ' || route || coalesce(' (' || agency || ')', '') AS problem FROM st WHERE NOT EXISTS (SELECT 1 FROM stops x WHERE x.k = st.k AND x.step = st.step)),
far AS (SELECT k, arg_min('no stop of route ' || route || ' within 800 m of the ' || CASE step WHEN 0 THEN 'start' ELSE 'end' END, step) AS problem FROM st JOIN pl USING (k) WHERE k NOT IN (SELECT k FROM missing)
  AND NOT EXISTS (SELECT 1 FROM stops x JOIN foot ON foot.u = x.node WHERE x.k = st.k AND x.step = st.step AND foot.v = CASE st.step WHEN 0 THEN a ELSE z END) GROUP BY k),
bad AS (SELECT * FROM missing UNION ALL SELECT * FROM far)
SELECT k AS chain_id, round(c, 2) AS cost, CAST(NULL AS VARCHAR) AS problem FROM done WHERE k NOT IN (SELECT k FROM bad) UNION ALL SELECT k, NULL, problem FROM bad
UNION ALL SELECT k, NULL, 'the routes do not connect in this order within the transfer walk limit' FROM pl WHERE k NOT IN (SELECT k FROM bad) AND k NOT IN (SELECT k FROM done)""",
    "pareto_profile": """WITH r AS (SELECT DISTINCT l_suppkey AS route_id, l_orderkey % 86400 AS dep, l_orderkey % 86400 + l_partkey * 13 % 5000 AS arr FROM lineitem)
SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.route_id = a.route_id AND b.arr <= a.arr AND (b.dep > a.dep OR (b.dep = a.dep AND b.arr < a.arr)))""",
    "profile_totals": """SELECT l_suppkey AS route_id, count(*) AS connections, CAST(min(l_partkey * 13 % 5000) AS BIGINT) AS min, CAST(floor(median(l_partkey * 13 % 5000)) AS BIGINT) AS median, CAST(max(l_partkey * 13 % 5000) AS BIGINT) AS max FROM lineitem GROUP BY 1""",
    "route_totals": """WITH l AS (SELECT l_orderkey AS r, l_linenumber % 3 AS k, l_returnflag = 'N' AS ride, CAST(l_partkey % 900 AS DOUBLE) AS time, CAST(l_quantity AS DOUBLE) AS f, CAST(l_suppkey % 700 AS DOUBLE) AS dist FROM lineitem)
SELECT r AS route_id, min(f) FILTER (ride) AS bottleneck, count(*) FILTER (ride) AS boardings, coalesce(sum(time) FILTER (ride), 0) AS ride_s, coalesce(sum(time) FILTER (NOT ride), 0) AS walk_s,
  round(coalesce(sum(57600 / f / 2) FILTER (ride), 0), 4) AS wait_s, coalesce(max(dist) FILTER (NOT ride), 0) AS longest_walk, round(coalesce(sum(f / 8) FILTER (ride AND k = 0), 0), 4) AS miles_0,
  round(coalesce(sum(f / 8) FILTER (ride AND k = 1), 0), 4) AS miles_1, round(coalesce(sum(f / 8) FILTER (ride AND k = 2), 0), 4) AS miles_2 FROM l GROUP BY r""",
    "replayed_profile": """WITH sn AS (SELECT greatest(count(*) // 5, 2) AS n FROM supplier), b AS (SELECT l_suppkey % n AS r, l_linenumber % 2 * 2 + 1 AS leg, l_partkey % 3 AS p, l_orderkey * 61 % 86400 AS dep, min(l_partkey % 1800 + 300) AS ride FROM lineitem, sn GROUP BY 1, 2, 3, 4),
s AS (SELECT r, leg, p, dep, min(dep + ride) OVER (PARTITION BY r, leg, p ORDER BY dep DESC) AS arr FROM b),
o AS (SELECT r, leg, p, dep + k * 86400 AS at, arr + k * 86400 AS arr FROM s, range(0, 5) t(k)),
k AS (SELECT DISTINCT r, leg, p FROM b),
t AS (SELECT r, t0 FROM (SELECT DISTINCT r FROM b), range(0, 172800, 60) x(t0)),
one AS (SELECT a.r, a.t0, min(o.arr) AS t FROM (SELECT t.r, t0, p, leg FROM t JOIN k ON k.r = t.r AND k.leg = 1) a ASOF JOIN o ON o.r = a.r AND o.leg = a.leg AND o.p = a.p AND a.t0 <= o.at GROUP BY 1, 2),
two AS (SELECT a.r, a.t0, min(o.arr) AS arr FROM (SELECT one.r, t0, one.t + 120 + 120 AS ready, p, leg FROM one JOIN k ON k.r = one.r AND k.leg = 3) a ASOF JOIN o ON o.r = a.r AND o.leg = a.leg AND o.p = a.p AND a.ready <= o.at GROUP BY 1, 2),
c AS (SELECT r, arr, max(t0) AS dep FROM two GROUP BY 1, 2 HAVING max(t0) < 86400),
m AS (SELECT *, min(arr) OVER (PARTITION BY r ORDER BY dep DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM c)
SELECT r AS route_id, count(*) AS connections, CAST(min(arr - dep) AS BIGINT) AS min, CAST(floor(median(arr - dep)) AS BIGINT) AS median, CAST(max(arr - dep) AS BIGINT) AS max FROM m WHERE later IS NULL OR arr < later GROUP BY 1""",
    "next_trips": """WITH sn AS (SELECT greatest(count(*) // 2, 2) AS n FROM supplier), o AS (SELECT l_suppkey % n AS r, l_linenumber % 3 AS p, l_orderkey * 61 % 86400 AS dep, min(l_orderkey * 61 % 86400 + 300 + l_partkey % 1800) AS arr FROM lineitem, sn GROUP BY 1, 2, 3),
a AS (SELECT c_custkey, c_custkey % n AS r, c_custkey * 97 % 86400 AS ready, (g - 1) * 86400 AS off FROM customer, sn, generate_series(0, 3) t(g)),
m AS (SELECT c_custkey, p, off, dep + off AS dep, arr + off AS arr, min(off) OVER (PARTITION BY c_custkey, p) AS first FROM a JOIN o USING (r) WHERE dep + off >= ready),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY arr, dep DESC) AS n FROM m WHERE off = first) SELECT c_custkey, dep, arr FROM b WHERE n = 1""",
    "leg_statistics": f"""WITH sn AS (SELECT greatest(count(*) // 2, 2) AS n FROM supplier), o AS (SELECT l_suppkey % n AS r, l_linenumber % 2 AS l, l_partkey % 9 % 6 AS name, l_orderkey * 61 % 86400 AS dep FROM lineitem, sn), u AS (SELECT DISTINCT r, l, dep FROM o), {frequency('u', '(r, l)', 'dep')},
t AS (SELECT r, l, name, row_number() OVER (PARTITION BY r, l ORDER BY count(*) DESC, name DESC) AS n FROM o WHERE dep >= 21600 AND dep < 79200 GROUP BY r, l, name)
SELECT u.r AS route_id, u.l AS leg_no, count(*) FILTER (dep >= 21600 AND dep < 79200) AS in_window, count(*) AS all_day, CAST(min(dep) AS INTEGER) AS first, CAST(max(dep) AS INTEGER) AS last,
  round(any_value(CASE WHEN freq > 0 THEN 57600 / freq END), 2) AS headway, any_value(CAST(t.name AS VARCHAR)) AS top FROM u JOIN f ON f.key = (u.r, u.l) LEFT JOIN t ON t.r = u.r AND t.l = u.l AND t.n = 1 GROUP BY 1, 2""",
    "duplicate_feeds": f"""WITH {CATALOG}, m AS (SELECT *, min(CASE WHEN status <> 'inactive' THEN feed_id END) OVER (PARTITION BY name) AS live FROM cat)
SELECT feed_id, CASE WHEN status = 'inactive' AND live IS NOT NULL THEN 'inactive duplicate of ' || live END AS reason FROM m""",
    "pruned_frontier": """WITH RECURSIVE c AS (SELECT l_orderkey AS k, l_linenumber AS n, max(CAST(l_extendedprice AS DOUBLE)) AS cost FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM c),
r AS (SELECT k, n, cost, i, TRUE AS kept, cost AS last FROM o WHERE i = 1 UNION ALL SELECT o.k, o.n, o.cost, o.i, o.cost <= 0.95 * r.last, CASE WHEN o.cost <= 0.95 * r.last THEN o.cost ELSE r.last END FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
SELECT k AS l_orderkey, n AS l_linenumber, round(cost, 4) AS cost FROM r WHERE kept""",
    "ride_costs": """WITH l AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q, CAST(l_partkey % 3000 AS DOUBLE) AS t, CAST(l_suppkey % 1500 AS DOUBLE) AS w FROM lineitem),
c AS (SELECT l_orderkey, t + 0.5 * 57600 / q + 300 + q / 5 * 60 + q / 3 * 180 AS ride, greatest(q * 40 * 1.3 / 1.25, 1) AS s, least(greatest(1000 - w, 0), q * 40) / (q * 40) AS near FROM l)
SELECT l_orderkey, round(sum(ride), 2) AS ride, round(sum(s * (near * 1.5 + (1 - near) * 3)), 2) AS walk FROM c GROUP BY 1""",
    "first_agencies": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 500 ORDER BY c_custkey) AS n FROM customer WHERE c_custkey % 5 IN (0, 1, 4))
SELECT c_nationkey AS feed_id, CAST(c_custkey % 500 AS VARCHAR) AS route_id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 <> 0 THEN c_custkey || ' Long' WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS VARCHAR)
  WHEN c_custkey % 2 <> 0 THEN 'Long' ELSE CAST(c_custkey % 500 AS VARCHAR) END AS route_name, n_name || CASE WHEN c_custkey % 4 = 1 THEN '1' ELSE '0' END AS agency
FROM k JOIN nation ON n_nationkey = c_nationkey WHERE n = 1 AND n_name NOT LIKE 'FRANCE%'""",
    "frequency_copies": f"""WITH {FILLED}, f AS (SELECT o_orderkey AS trip, o_custkey % 20 * 3600 AS a, o_orderkey % 5 * 600 AS h FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 5 > 0),
s AS (SELECT DISTINCT trip, unnest(range(a, a + 3600, h)) AS t0 FROM f), own AS (SELECT *, first_value(t) OVER (PARTITION BY trip ORDER BY pos) AS dep0 FROM filled),
x AS (SELECT own.trip, s.t0, t + s.t0 - dep0 AS t FROM own JOIN s USING (trip) UNION ALL SELECT trip, NULL, t FROM own WHERE trip NOT IN (SELECT trip FROM f))
SELECT CAST(trip AS VARCHAR) AS trip_id, count(DISTINCT coalesce(t0, -1)) AS copies, CAST(min(t) AS INTEGER) AS first_dep, CAST(max(t) AS INTEGER) AS last_arr FROM x GROUP BY trip""",
}

NORM = r"rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '/')"
ZONES = f"""z AS (SELECT n_nationkey AS id, 40 + n_nationkey % 5 / 10.0 AS lat, -75 + n_nationkey // 5 / 10.0 AS lon FROM nation),
c AS (SELECT id, i, lat + [0, 0, 0.06, 0.05][i] AS lat, lon + [0, 0.08, 0.09, 0.01][i] AS lon FROM z, generate_series(1, 4) t(i)),
e AS (SELECT a.id, radians(CAST(a.lon AS DOUBLE)) * {X!r} AS x0, radians(CAST(a.lat AS DOUBLE)) * 6371000.0 AS y0, radians(CAST(b.lon AS DOUBLE)) * {X!r} AS x1, radians(CAST(b.lat AS DOUBLE)) * 6371000.0 AS y1 FROM c a JOIN c b ON a.id = b.id AND b.i = a.i % 4 + 1),
inside AS (SELECT id, node FROM e, plane WHERE (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""
SAMPLES = ", ".join(f"({a[0] + (b[0] - a[0]) * k / 19!r}::DOUBLE, {a[1] + (b[1] - a[1]) * k / 19!r}::DOUBLE)" for a, b in zip(SPINE, SPINE[1:], strict=False) for k in range(20))

SQL |= {
    "selected_feeds": f"""WITH {CATALOG}, box AS (SELECT *, CAST(39.5 + feed_id % 20 / 10.0 AS DOUBLE) AS south, CAST(-76 + feed_id % 30 / 10.0 AS DOUBLE) AS west FROM cat),
p AS (SELECT feed_id, radians(west + (west + 0.1::DOUBLE - west) * j / 4) * {X!r} AS x, radians(south + (south + 0.1::DOUBLE - south) * i / 4) * 6371000.0 AS y FROM box, generate_series(0, 4) t(i), generate_series(0, 4) u(j)),
near AS (SELECT feed_id FROM p GROUP BY 1 HAVING min({_spine('x', 'y')}) <= 20000 UNION SELECT feed_id FROM box JOIN (VALUES {SAMPLES}) s(lat, lon) ON s.lat BETWEEN south AND south + 0.1::DOUBLE AND s.lon BETWEEN west AND west + 0.1::DOUBLE)
SELECT feed_id, until < DATE '2026-09-30' AS stale, CASE WHEN status = 'deprecated' THEN 'status deprecated' WHEN bare THEN 'no hosted dataset' WHEN feed_id NOT IN (SELECT feed_id FROM near) THEN 'outside the corridor' END AS reason FROM box""",
    "atlas_matches": f"""WITH p AS (SELECT page_id, url, {NORM} AS place FROM pages), h AS (SELECT regexp_extract(place, '^([^/]*)', 1) AS host, min(url) AS url, min(page_id) AS n FROM p GROUP BY 1),
a AS (SELECT host, n, {NORM} AS place FROM h WHERE url <> ''), u AS (SELECT DISTINCT page_id, host FROM p JOIN a USING (place) WHERE place <> '')
SELECT page_id AS feed_id, host AS onestop_id, TRUE AS by_url FROM u UNION ALL SELECT DISTINCT page_id, host, FALSE FROM p JOIN a ON n = page_id % 40 WHERE page_id NOT IN (SELECT page_id FROM u)""",
    "zone_boundaries": f"""WITH {STOPS}, {PLANE}, {ZONES}, t AS (SELECT id, node, x, y, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS t FROM e, plane),
d AS (SELECT id, node, min(sqrt(pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2))) AS dist FROM t GROUP BY 1, 2) SELECT id AS zone_id, node, round(dist, 2) AS dist FROM d ANTI JOIN inside USING (id, node) WHERE dist <= 500""",
    "zone_rides": f"""WITH {STOPS}, {PLANE}, {ZONES}, t AS (SELECT id, node, x, y, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS t FROM e, plane),
q AS (SELECT id, node, x0 + t * (x1 - x0) AS qx, y0 + t * (y1 - y0) AS qy, sqrt(pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2)) AS dist FROM t),
b AS (SELECT id, node, arg_min((qx, qy), (dist, qx, qy)) AS q, min(dist) AS dist FROM q ANTI JOIN inside USING (id, node) GROUP BY 1, 2),
k AS (SELECT id, arg_min(q, node) AS q FROM b WHERE dist <= 2500 GROUP BY id, floor(q[1] / 250), floor(q[2] / 250)),
access AS (SELECT id, x, y FROM inside JOIN plane USING (node) UNION ALL SELECT id, q[1], q[2] FROM k), far AS (SELECT *, row_number() OVER () AS n, row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS place
  FROM (SELECT *, avg(x) OVER (PARTITION BY id) AS mx, avg(y) OVER (PARTITION BY id) AS my FROM access)), near AS (SELECT * FROM far WHERE place <= 700)
SELECT a.id AS zone_id, count(*) AS rides, round(57600.0 * 57600 / (12 * 3600 * 3600 + 14400 * 14400), 4)::DOUBLE AS freq, round(max(greatest(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) * 1.35 / (35 / 3.6), 60)), 1)::DOUBLE AS longest FROM near a JOIN near b ON a.id = b.id AND a.n <> b.n GROUP BY 1""",
    "mirrored_patterns": f"""WITH {FILLED}, one AS (SELECT trip, list((pos, stop % 7) ORDER BY pos) AS seq, arg_min(t, pos) AS dep0, count(*) AS len FROM filled GROUP BY trip HAVING count(*) >= 2)
SELECT CAST(len AS BIGINT) AS stops, count(DISTINCT dep0) AS trips, CAST(min(dep0) AS INTEGER) AS first_dep, CAST(max(dep0) + 300 * (len - 1) AS INTEGER) AS last_dep FROM one GROUP BY seq, len""",
    "imputed_lanes": f"""WITH w0 AS (SELECT p_partkey AS id, p_brand AS name, ['motorway', 'trunk', 'primary', 'secondary', 'residential', 'footway'][p_size % 6 + 1] AS h, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 + 1 END AS n, p_partkey % 4 = 0 AS one,
  CAST(40.6 + (p_partkey * 7919 % 500) / 10000.0 AS DOUBLE) AS lat, CAST(-75 + (p_partkey * 104729 % 500) / 10000.0 AS DOUBLE) AS lon FROM part),
pt AS (SELECT id, i, radians(lon + (i % 2) * 0.001::DOUBLE) * {X!r} AS x, radians(lat + i * 0.001::DOUBLE) * 6371000.0 AS y FROM w0, generate_series(0, 2) t(i) WHERE h <> 'footway'),
g AS (SELECT id, sum(d) AS length, avg(x) AS x, avg(y) AS y FROM (SELECT *, sqrt(pow(x - lead(x) OVER w, 2) + pow(y - lead(y) OVER w, 2)) AS d FROM pt WINDOW w AS (PARTITION BY id ORDER BY i)) GROUP BY 1),
w AS (SELECT id, nullif(name, '') AS name, h, one, length, x, y, CAST(CASE WHEN one THEN n WHEN n IS NOT NULL THEN greatest(n // 2, 1) END AS DOUBLE) AS f FROM w0 JOIN g USING (id)),
d AS (SELECT a.id, arg_min(b.f, (sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id)) AS near FROM w a JOIN w b ON a.f IS NULL AND b.f IS NOT NULL AND a.name = b.name AND a.h = b.h AND a.one = b.one WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 1500 GROUP BY 1),
s AS (SELECT h, one, f, sum(sum(length)) OVER (PARTITION BY h, one ORDER BY f) AS running, sum(sum(length)) OVER (PARTITION BY h, one) AS whole FROM w WHERE f IS NOT NULL GROUP BY h, one, f),
m AS (SELECT h, one, greatest(1, round_even(min(f), 0)) AS median FROM s WHERE running >= whole / 2 GROUP BY 1, 2)
SELECT w.id AS way_id, CAST(w.one AS INTEGER) AS oneway, CAST(coalesce(f, near, median, 1) AS DOUBLE) AS fwd, CAST(CASE WHEN w.one THEN 1 ELSE coalesce(f, near, median, 1) END AS DOUBLE) AS bwd,
  CASE WHEN f IS NOT NULL THEN 'tagged' WHEN near IS NOT NULL THEN 'same street' ELSE 'street type' END AS source FROM w LEFT JOIN d USING (id) LEFT JOIN m ON m.h = w.h AND m.one = w.one""",
}

#: Road pieces of 40 m at most, shape pieces of 100 m with the side at their middle, and each shape piece's best road piece.
MATCHED = f"""imp AS ({SQL['imputed_lanes']}),
rn AS (SELECT p_partkey AS way, p_partkey % 7 = 0 AS off, p_size % 6 = 0 AS controlled, i, radians(CAST(-75 + (p_partkey * 104729 % 500) / 10000.0 + (i % 2) * 0.001 AS DOUBLE)) * {X!r} AS x, radians(CAST(40.6 + (p_partkey * 7919 % 500) / 10000.0 + i * 0.001 AS DOUBLE)) * 6371000.0 AS y FROM part, generate_series(0, 2) t(i)),
rs AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, CAST(ceil(sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) / 40) AS INTEGER) AS n FROM rn WINDOW w AS (PARTITION BY way ORDER BY i)),
class AS (SELECT way_id, oneway, fwd, bwd, source FROM imp),
rp AS MATERIALIZED (SELECT way, i || '-' || k AS piece, x + (nx - x) * k / n AS ax, y + (ny - y) * k / n AS ay, x + (nx - x) * (k + 1) / n AS ex, y + (ny - y) * (k + 1) / n AS ey, off, oneway, source,
  CASE WHEN controlled THEN 3 WHEN fwd < 1.5 THEN 0 WHEN fwd < 2.5 THEN 1 ELSE 2 END AS cf, CASE WHEN controlled THEN 3 WHEN bwd < 1.5 THEN 0 WHEN bwd < 2.5 THEN 1 ELSE 2 END AS cb FROM rs JOIN class ON way_id = way, range(0, n) t(k) WHERE nx IS NOT NULL),
s0 AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
  radians(CAST(-75 + (l_suppkey * 104729 % 50) / 10000.0 AS DOUBLE)) * {X!r} AS x, radians(CAST(40.6 + (l_partkey * 7919 % 50) / 10000.0 AS DOUBLE)) * 6371000.0 AS y FROM lineitem),
s1 AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM s0 WINDOW w AS (PARTITION BY id ORDER BY n)),
s2 AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS len FROM s1 WHERE d IS NULL OR d > 0.01 WINDOW w AS (PARTITION BY id ORDER BY n)),
s3 AS MATERIALIZED (SELECT *, coalesce(sum(len) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s2 WHERE len > 0),
tot AS (SELECT id, max(a + len) AS total FROM s3 GROUP BY id),
ask AS (SELECT id, k, w, CASE w WHEN 0 THEN k * 100.0 WHEN 2 THEN least((k + 1) * 100.0, total) ELSE (k * 100.0 + least((k + 1) * 100.0, total)) / 2 END AS pos FROM tot, range(0, CAST(greatest(ceil(total / 100 - 1e-9), 1) AS BIGINT)) t(k), range(0, 3) v(w)),
place AS (SELECT ask.id, k, w, x + least((pos - a) / len, 1) * (nx - x) AS x, y + least((pos - a) / len, 1) * (ny - y) AS y, (nx - x) / len AS hx, (ny - y) / len AS hy FROM ask ASOF JOIN s3 ON s3.id = ask.id AND ask.pos >= s3.a),
sp AS MATERIALIZED (SELECT id, k, max(x) FILTER (w = 1) AS mx, max(y) FILTER (w = 1) AS my, max(hx) FILTER (w = 1) AS hx, max(hy) FILTER (w = 1) AS hy,
  sqrt(pow((max(x) FILTER (w = 2) - max(x) FILTER (w = 0)) * cos(max(y) FILTER (w = 1) / 6371000.0) / {math.cos(math.radians(40.6))!r}, 2) + pow(max(y) FILTER (w = 2) - max(y) FILTER (w = 0), 2)) AS length FROM place GROUP BY id, k),
cell AS (SELECT rp.*, floor((ax + ex) / 2 / 50) + i AS cx, floor((ay + ey) / 2 / 50) + j AS cy, sqrt(pow(ex - ax, 2) + pow(ey - ay, 2)) AS side FROM rp, range(-1, 2) t(i), range(-1, 2) u(j)),
near AS (SELECT sp.id, k, way, piece, off, oneway, source, cf, cb, greatest(-1, least(1, (hx * (ex - ax) + hy * (ey - ay)) / side)) AS cosine, greatest(0, least(1, ((mx - ax) * (ex - ax) + (my - ay) * (ey - ay)) / (side * side))) AS share, mx, my, ax, ay, ex, ey
  FROM sp JOIN cell ON cx = floor(mx / 50) AND cy = floor(my / 50)),
scored AS (SELECT *, sqrt(pow(mx - ax - share * (ex - ax), 2) + pow(my - ay - share * (ey - ay), 2)) AS dist, degrees(acos(abs(cosine))) AS deg FROM near),
best AS (SELECT id, k, min((dist + 0.4 * deg + CASE WHEN oneway * sign(cosine) < 0 THEN 15 ELSE 0 END + CASE WHEN off THEN 12 ELSE 0 END, way, piece, CASE WHEN cosine >= 0 THEN cf ELSE cb END, source)) AS b FROM scored WHERE dist <= 25 AND deg <= 40 GROUP BY id, k)"""
SQL["matched_roads"] = f"""WITH {MATCHED}, c AS (SELECT coalesce(b[5], 'unmatched') AS source, sum(length) AS metres FROM sp LEFT JOIN best USING (id, k) GROUP BY 1)
SELECT source, round(metres, 1) AS metres, round(metres / sum(metres) OVER (), 4) AS share FROM c"""
