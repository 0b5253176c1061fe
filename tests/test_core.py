"""Timetable jobs on small feeds with known results."""

import bisect
import itertools
import json
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from transit_spark.config import LOCAL, Prices
from transit_spark.functions import text
from transit_spark.operators import calendar, flex, frequency, locality, replay, search, timetable, walks
from transit_spark.plans.sql import SQL
from transit_spark.sources import documents, gtfs

H = 3600


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def hms(t):
    return f"{t // 3600:02d}:{t % 3600 // 60:02d}:{t % 60:02d}"


def write_feed(path, stops, routes, shape=None, freqs=(), days="1,1,1,1,1,0,0", span="20260101,20261231"):
    """stops {id: (lat, lon)}; routes {id: (stop ids, [(departure, ride seconds)])}."""
    rows = {
        "agency": ["agency_id,agency_name,agency_url,agency_timezone", "A,Test Agency,u,UTC"],
        "stops": ["﻿stop_id, stop_name,stop_lat,stop_lon", *[f"{k},{k},{a},{b}" for k, (a, b) in stops.items()]],
        "routes": ["route_id,agency_id,route_short_name,route_long_name,route_type", *[f"{k},A,{k},,3" for k in routes]],
        "calendar": ["service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date", f"WK,{days},{span}"],
        "trips": ["route_id,service_id,trip_id,trip_headsign,shape_id"], "stop_times": ["trip_id,arrival_time,departure_time,stop_id,stop_sequence"],
    }
    for r, (seq, trips) in routes.items():
        for k, (t0, ride) in enumerate(trips):
            rows["trips"].append(f"{r},WK,{r}_{k},to end,")
            rows["stop_times"] += [f"{r}_{k},{hms(t0 + ride * i)},{hms(t0 + ride * i)},{s},{i + 1}" for i, s in enumerate(seq)]
    if freqs:
        rows["frequencies"] = ["trip_id,start_time,end_time,headway_secs", *freqs]
    with zipfile.ZipFile(path, "w") as z:
        for name, lines in rows.items():
            z.writestr(f"feed/{name}.txt", "\n".join(lines) + "\n")


def every(a, b, minutes, ride):
    return [(t, ride) for t in range(a * H, b * H, minutes * 60)]


def compiled(spark, path):
    read = lambda n, c, required=True: gtfs.read_gtfs_table(spark, str(path), n, c, required)
    feeds = read("agency", ["agency_id"]).select("feed_id", F.lit("P").alias("provider")).distinct()
    routes = timetable.bus_routes(read("routes", ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"]), read("agency", ["agency_id", "agency_name"]), feeds)
    trips = read("trips", ["route_id", "service_id", "trip_id", "trip_headsign", "shape_id"])
    week = calendar.weekly_services(read("calendar", ["service_id", *calendar.DAYS, "start_date", "end_date"]))
    none = calendar.exception_dates(read("calendar_dates", ["service_id", "date", "exception_type"], False))
    chosen = calendar.choose_service_date(week, none, trips, "2026-09-30")
    on = calendar.services_on(week, none, chosen.select("feed_id", F.col("service_date").alias("date")))
    trips = trips.join(on, ["feed_id", "service_id"], "left_semi")
    raw = read("stop_times", ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "pickup_type", "drop_off_type"])
    stops = timetable.valid_stops(read("stops", ["stop_id", "stop_name", "stop_lat", "stop_lon"]), raw)
    rows = timetable.expand_frequencies(timetable.clean_stop_times(raw, trips, stops), read("frequencies", ["trip_id", "start_time", "end_time", "headway_secs"], False))
    return (*timetable.compile_patterns(rows, trips, routes), stops, chosen)


@pytest.fixture(scope="session")
def network(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("feeds")
    write_feed(path / "f1.zip", {"A": (40.0, -75.0), "B": (40.1, -75.0), "C": (40.0, -74.8)}, {"FAST": (["A", "B"], [(8 * H, 600)]), "FREQ": (["A", "C"], every(6, 22, 15, 1800))})
    write_feed(path / "f2.zip", {"B2": (40.1005, -75.0), "C2": (40.0005, -74.8), "D": (40.3, -75.0)}, {
        "BX": (["B2", "D"], every(6, 22, 10, 900)), "C1": (["C2", "D"], every(6, 22, 60, 1200)), "C2": (["C2", "D"], [(t + 1800, r) for t, r in every(6, 22, 60, 1200)])})
    patterns, stops, times, places, chosen = (search.cut(x) for x in compiled(spark, path))
    rank = places.select("feed_id").distinct().withColumn("feed_rank", F.col("feed_id"))
    nodes, mapping = frequency.merge_stops(places, rank)
    nodes, mapping = search.cut(nodes), search.cut(mapping)
    placed = search.cut(stops.join(mapping, ["feed_id", "stop_id"]))
    miles = locality.stop_density_miles(placed, nodes)
    edges = frequency.pool_edges(frequency.stop_pairs(placed, frequency.effective_frequency(times, ["pattern_id", "pos"]), frequency.running_profile(times), miles))
    edges = search.cut(edges)
    here = spark.createDataFrame([(1, 40.0, -75.0, "origin"), (2, 40.3, -75.0, "destination")], "node bigint, lat double, lon double, role string")
    links = walks.walk_edges(nodes).unionByName(walks.attach_places(nodes, here))
    links = search.cut(links)
    rides = edges.select("u", "v", "freq", "time", F.array("miles_0", "miles_1", "miles_2").alias("miles"), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("bigint").alias("zone_id"))
    return dict(patterns=patterns, stops=placed, times=times, nodes=nodes, edges=edges, miles=search.cut(miles), g=search.Network(search.cut(rides), links), chosen=chosen)


def test_compile(network):
    trips = {r.route_id: r.n for r in network["times"].join(network["patterns"], "pattern_id").groupBy("route_id").agg(F.countDistinct("trip_no").alias("n")).collect()}
    assert trips == {"FAST": 1, "FREQ": 64, "BX": 96, "C1": 16, "C2": 16}


def test_parallel_routes_are_pooled(network):
    names = {r.stop_id: r.node for r in network["nodes"].collect()}
    freq = {(r.u, r.v): r.freq for r in network["edges"].collect()}
    assert freq[names["C2"], names["D"]] == pytest.approx(32)
    assert freq[names["A"], names["B"]] == pytest.approx(1)


def test_bottleneck_frontier_and_replay(spark, network):
    g = network["g"]
    best = search.max_bottleneck(g, spark.createDataFrame([(1,)], "origin bigint")).where("node = 2").first().freq
    assert best == pytest.approx(32)
    pairs = spark.createDataFrame([(7, 1, 2, best), (8, 1, 2, 1.0)], "query_id int, origin bigint, destination bigint, best double")
    routes, legs = search.frontier(g, pairs, min_gain=-10)
    found = {(r.query_id, r.place): r.bottleneck for r in routes.collect()}
    assert found[7, 0] == pytest.approx(32) and min(found.values()) <= 32 and {q for q, _ in found} == {7, 8}
    main = legs.where("query_id = 7 and place = 0").orderBy("leg_no").collect()
    assert [x.kind for x in main].count("ride") == 2 and min(x.freq for x in main if x.freq) == pytest.approx(best)
    mine = legs.where("query_id = 7 and place = 0").withColumnRenamed("query_id", "route_id")
    mine = search.cut(mine)
    options = search.cut(replay.serving_options(mine.where("kind = 'ride'"), network["stops"], network["times"], network["miles"]))
    windows = spark.createDataFrame([], "zone_id bigint, weekday int, start int, end int, headway int")
    done = replay.replay(mine, options, windows, replay.sweep(mine.select("route_id").distinct(), 300))
    profile = replay.connection_profile(done, mine).collect()
    assert len(profile) >= 30 and all(p.arr > p.dep for p in profile)
    assert [p.arr for p in sorted(profile)] == sorted(p.arr for p in profile)


def test_replayed_profile_against_brute_force(spark):
    """The registered query against a sweep of every minute of two days, start by start."""
    from transit_spark.plans.queries import replayed_profile

    folder, day = "/root/testdata/sf0.001", 24 * H
    options = {}
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_partkey", "l_orderkey").collect():
        leg = options.setdefault((r.l_suppkey % 2, r.l_linenumber % 2 * 2 + 1), {}).setdefault(r.l_partkey % 3, {})
        dep = r.l_orderkey * 61 % day
        leg[dep] = min(leg.get(dep, 10 * day), dep + r.l_partkey % 1800 + 300)
    best = {}  # departures of a pattern in order, each with the earliest arrival from then on
    for key, patterns in options.items():
        for trips in patterns.values():
            deps = sorted(trips)
            best.setdefault(key, []).append((deps, list(itertools.accumulate((trips[d] for d in reversed(deps)), min))[::-1]))

    def ride(key, ready):
        found = []
        for deps, arrivals in best[key]:
            off = ready // day * day
            i = bisect.bisect_left(deps, ready - off)
            found.append(arrivals[i] + off if i < len(deps) else arrivals[0] + off + day)
        return min(found)

    expected = {}
    for route in {r for r, _ in options}:
        latest = {}
        for t0 in range(0, 2 * day, 60):
            latest[ride((route, 3), ride((route, 1), t0) + 120 + 120)] = t0  # the walk, and the slack that a walk doesn't spare
        kept, soonest = [], 10 * day
        for dep, arr in sorted(((d, a) for a, d in latest.items()), reverse=True):
            if arr < soonest:
                kept, soonest = kept + [(dep, arr)], arr
        took = [a - d for d, a in kept if d < day]
        expected[route] = (len(took), min(took), int(statistics.median(took)), max(took))
    assert {r.route_id: tuple(r)[1:] for r in replayed_profile(spark, folder).collect()} == expected


def test_slack_outlives_walks_and_flex(spark):
    """Ride (arrives 1000), walk 60 s, ride: one is ready at 1180 and takes the trip of 1300, not that of 1100; the same after an on-demand ride."""
    option = lambda route, leg, trip, dep, arr: (route, leg, 10 * leg, trip, dep, arr)
    options = spark.createDataFrame([option(r, 1, 1, 500, 1000) for r in (1, 2)] + [option(r, 3, t, d, d + 50) for r in (1, 2) for t, d in ((1, 1100), (2, 1300))], "route_id int, leg_no int, pattern_id int, trip_no int, dep int, arr int")
    legs = spark.createDataFrame([(1, 1, "ride", 0.0, None), (1, 2, "walk", 60.0, None), (1, 3, "ride", 0.0, None), (2, 1, "ride", 0.0, None), (2, 2, "flex", 30.0, 7), (2, 3, "ride", 0.0, None)], "route_id int, leg_no int, kind string, time double, zone_id int")
    windows = spark.createDataFrame([(7, 2, 0, 24 * H - 1, None)], "zone_id int, weekday int, start int, end int, headway int")
    starts = spark.createDataFrame([(1, 400), (2, 400)], "route_id int, t0 int")
    one = {(r.route_id, r.leg_no): (r.wait_from, r.dep, r.arr) for r in replay.replay(legs, options, windows, starts).collect()}
    assert one[1, 3] == (1060, 1300, 1350)
    assert one[2, 2] == (1000, 2800, 2830) and one[2, 3] == (2830, 1100 + 24 * H, 1150 + 24 * H)


def _stepped(legs, windows, t0, day=24 * H):
    """The arrival of one start, leg by leg and trip by trip; None where no trip is left."""
    t, rode, board = t0, False, None
    for kind, time, zone, trips in legs:
        if kind == "walk":
            t, board = t + round(time), None
            continue
        if kind == "flex":
            times = [max(t + 1800, s + k * day) for k in range(t // day, t // day + 8) for s, e in windows[zone] if max(t + 1800, s + k * day) <= e + k * day]
            if not times:
                return None
            t, board = min(times) + round(time), None
        else:
            ready, found = t + (120 if rode else 0), []
            for pattern in {p for p, *_ in trips}:
                for k in range(ready // day - 1, ready // day + 3):
                    fits = [(a + k * day, -(d + k * day), pattern, n, k * day) for p, n, d, a in trips if p == pattern and d + k * day >= ready]
                    if fits:
                        found.append(min(fits))
                        break
            best = min(found, default=None)
            stay = [(a + board[2], 0, p, n, board[2]) for p, n, d, a in trips if board and (p, n) == board[:2] and d + board[2] >= t]
            if stay and (best is None or stay[0][0] <= best[0]):
                best = stay[0]
            if best is None:
                return None
            t, board = best[0], best[2:]
        rode = True
    return t


def test_route_profiles_against_every_start(spark):
    """Merged starts give the connections of a replay of all 2880, and of one that is stepped through by hand."""
    import random

    rng = random.Random(8)
    shapes = [["walk", "ride", "walk", "ride"], ["ride", "ride", "walk"], ["ride", "flex", "ride"], ["flex", "ride"], ["walk", "flex"], ["ride"], ["walk"], ["ride", "ride", "ride"]]
    legs, options, by_route = [], [], {}
    for route, shape in enumerate(shapes):
        own = []
        for n, kind in enumerate(shape, 1):
            time = rng.choice([0.4, 61.0, 200.6, 900.5])
            legs.append((route, n, kind, time, 7 if kind == "flex" else None))
            trips = []
            if kind == "ride":
                for pattern in (1, 2):
                    for trip in range(12):
                        # Trips of one number ride through: a later leg begins where the one before it ends, or a little later. Some run past midnight.
                        dep = trip * 7300 + pattern * 977 + (n - 1) * 700 + rng.choice([0, 0, 30, 400])
                        trips.append((pattern, trip, dep, dep + rng.choice([650, 700, 1900])))
                options += [(route, n, *t) for t in trips]
            own.append((kind, time, 7, trips))
        by_route[route] = own
    hours = {7: [(6 * H, 9 * H), (15 * H, 16 * H)]}
    leg_rows = spark.createDataFrame(legs, "route_id int, leg_no int, kind string, time double, zone_id int")
    option_rows = spark.createDataFrame(options, "route_id int, leg_no int, pattern_id int, trip_no int, dep int, arr int")
    windows = spark.createDataFrame([(7, 2, s, e, None) for s, e in hours[7]], "zone_id int, weekday int, start int, end int, headway int")
    found = sorted(tuple(r) for r in replay.route_profiles(leg_rows, option_rows, windows).collect())
    want = []
    for route, own in by_route.items():
        latest = {}
        for t0 in range(0, 48 * H, 60):
            if (arr := _stepped(own, hours, t0)) is not None:
                latest[arr] = t0
        soonest = None
        for dep, arr in sorted(((d, a) for a, d in latest.items() if d < 24 * H), reverse=True):
            if soonest is None or arr < soonest:
                want.append((route, dep, arr))
                soonest = arr
    assert found == sorted(want)
    starts = replay.telling_starts(leg_rows, option_rows).groupBy("route_id").count().collect()
    assert {r["count"] for r in starts if r.route_id in (3, 4, 6)} == {2880} and max(r["count"] for r in starts if r.route_id not in (3, 4, 6)) < 120
    swept = replay.replay(leg_rows, option_rows, windows, replay.sweep(leg_rows.select("route_id").distinct().where("route_id in (0, 2, 3)"), 600))
    ends = {(r.route_id, r.t0): r.arr for r in swept.join(leg_rows.groupBy("route_id").agg(F.max("leg_no").alias("leg_no")), ["route_id", "leg_no"]).collect()}
    assert ends == {(r, t0): arr for r in (0, 2, 3) for t0 in range(0, 48 * H, 600) if (arr := _stepped(by_route[r], hours, t0)) is not None}


RIDE = "u bigint, v bigint, freq double, time double, miles array<double>, dist double, zone_id bigint"


def test_required_walk(spark):
    """Two walks of 1500.5 m need 3001 m, but limits are link lengths; every query has a limit and layers of its own."""
    ride = lambda u, v: (u, v, 4.0, 60.0, [0.0] * 3, None, None)
    rides = spark.createDataFrame([ride(1, 2), ride(3, 4), ride(6, 7)], RIDE)
    links = spark.createDataFrame([(2, 5, 1500.0, 1500.5), (5, 3, 1500.0, 1500.5), (2, 3, 3100.0, 3500.25), (7, 8, 1.0, 900.75)], "u bigint, v bigint, time double, dist double")
    asked = spark.createDataFrame([(1, 1, 4), (2, 6, 8), (3, 6, 7), (4, 1, 8)], "query_id int, origin bigint, destination bigint")
    need = {r.query_id: r.max_walk for r in search.required_walk(search.Network(rides, links), asked).collect()}
    assert need == {1: 3500.25, 2: 900.75, 3: 800.0}


def _random_network(spark, seed, nodes=30):
    import random

    rng = random.Random(seed)
    rides = [(rng.randrange(nodes), rng.randrange(nodes), rng.choice([1.0, 4.0, 16.0, 40.0]), rng.uniform(60, 2000), [rng.uniform(0, 3), 0.0, rng.uniform(0, 2)], None, None) for _ in range(nodes * 3)]
    walks = [(u, (u + rng.randrange(1, 4)) % nodes, 0.0, rng.uniform(50, 700)) for u in range(nodes) for _ in range(2)]
    walks = [(u, v, d * 1.04, d) for u, v, _, d in walks]
    rides = [r for r in rides if r[0] != r[1]]
    return rides, walks, search.Network(spark.createDataFrame(rides, RIDE), spark.createDataFrame(walks, "u bigint, v bigint, time double, dist double"))


def _least_costs_by_hand(rides, walks, origin, threshold, max_walk=800.0, p=Prices()):
    """Bellman-Ford over (node, layer)."""
    import math

    step = max(400.0, max_walk / 24)
    best, changed = {(origin, 0): 0.0}, True
    while changed:
        changed = False
        for (node, layer), label in list(best.items()):
            for u, v, f, t, m, *_ in rides:
                if u == node and f >= threshold:
                    c = label + max(p.riding * t + p.headway_share * 57600 / f + p.boarding + sum(a * b for a, b in zip(m, p.mile)), 1) + 1e-3
                    if c < best.get((v, 0), math.inf) - 1e-9:
                        best[v, 0], changed = c, True
            for u, v, t, d in walks:
                if u == node and layer * step + d <= max_walk:
                    near = min(max(p.far_after - layer * step, 0), d) / d
                    c, to = label + max(t * (near * p.walking + (1 - near) * p.far_walking), 1), math.ceil((layer * step + d) / step)
                    if c < best.get((v, to), math.inf) - 1e-9:
                        best[v, to], changed = c, True
    out = {}
    for (node, _), c in best.items():
        out[node] = min(c, out.get(node, math.inf))
    return out


def test_best_routes_against_brute_force(spark):
    """Costs of many queries at once, and fewer states where the destination bounds the search."""
    rides, walks, g = _random_network(spark, 3)
    asked = [(i, i % 7, (i * 11 + 5) % 30, [0.0, 4.0, 16.0][i % 3]) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id int, origin bigint, destination bigint, threshold double")
    routes, legs = search.best_routes(g, queries)
    found = {r.query_id: r.cost for r in routes.collect()}
    want = {q: c for q, o, d, t in asked if (c := _least_costs_by_hand(rides, walks, o, t).get(d)) is not None}
    assert found == pytest.approx(want) and len(want) >= 8
    p = Prices()
    paid = {}
    for leg in sorted(legs.collect(), key=lambda r: (r.query_id, r.leg_no)):
        paid.setdefault(leg.query_id, []).append(leg)
    for q, o, d, t in asked:
        if q in found and o != d:
            assert paid[q][0].u == o and paid[q][-1].v == d and all(a.v == b.u for a, b in zip(paid[q], paid[q][1:]))
            assert all(a.freq >= t for a in paid[q] if a.kind == "ride") and not any(a.kind == b.kind == "walk" for a, b in zip(paid[q], paid[q][1:]))
    priced, short = search.priced_rides(g, p), search.shortest_walks(g.walks)
    ahead = search.cheapest_ahead(g, queries.select(F.col("query_id").alias("goal"), "destination"), p)
    count = lambda **more: search.least_costs(g, queries.withColumn("goal", F.col("query_id")), priced, short, p, **more).count()
    whole, bounded, aimed = count(bounded=False), count(), count(ahead=ahead)
    assert aimed < bounded < whole, (aimed, bounded, whole)
    assert {r.query_id: r.cost for r in search.best_routes(g, queries.withColumn("goal", F.col("query_id")), p, ahead=ahead)[0].collect()} == pytest.approx(want)


def test_recommend_against_brute_force(spark):
    """Best bottleneck, its least cost, the most local ways and the pruned ladder of every pair; a pair that needs a longer walk, and one that nothing connects."""
    rides, walks, _ = _random_network(spark, 5, 12)
    rides += [(40, 41, 4.0, 60.0, [0.0] * 3, None, None)]
    walks += [(41, 42, 936.0, 900.0)]
    g = search.Network(spark.createDataFrame(rides, RIDE), spark.createDataFrame(walks, "u bigint, v bigint, time double, dist double"))
    asked = [(1, 0, 7), (2, 3, 11), (3, 5, 9), (4, 40, 42), (5, 42, 0)]
    pairs = spark.createDataFrame(asked, "query_id int, origin bigint, destination bigint")
    for by in ("cost", "local"):
        routes, legs = search.recommend(g, pairs, Prices(), LOCAL, by=by)
        rows = {}
        for r in sorted(routes.collect(), key=lambda r: (r.query_id, r.place)):
            rows.setdefault(r.query_id, []).append(r)
        assert set(rows) == {1, 2, 3, 4} and rows[4][0].max_walk == 901.0 and rows[4][0].label == search.RECOMMENDED
        nodes = {}
        for leg in sorted(legs.collect(), key=lambda r: (r.query_id, r.place, r.leg_no)):
            nodes.setdefault((leg.query_id, leg.place), []).append((leg.u, leg.v))
        for q, o, d in asked[:3]:
            best = max(t for t in (1.0, 4.0, 16.0, 40.0) if d in _least_costs_by_hand(rides, walks, o, t))
            assert rows[q][0].threshold == best and rows[q][0].cost == pytest.approx(_least_costs_by_hand(rides, walks, o, best)[d])
            own = [tuple(n) for k, n in sorted(nodes.items()) if k[0] == q]
            assert len(own) == len(set(own)) == len(rows[q])
            ladder = [best, *sorted({round(960 / m, 2) for m in (10, 15, 20, 30, 40, 45, 60, 75, 90, 120, 150, 180, 240, 300, 360, 480, 720)} - {best}, reverse=True), 0.0]
            kept = []
            for t in [t for t in ladder if t <= best]:
                c = _least_costs_by_hand(rides, walks, o, t, p=Prices() if by == "cost" else LOCAL)[d]
                if not kept or c <= 0.95 * kept[-1]:
                    kept.append(c)
            offered = [r.cost for r in rows[q] if ("TRADE" in r.label if by == "cost" else r.label != search.RECOMMENDED)]
            assert all(any(c == pytest.approx(k) for k in kept) for c in offered)


def test_chains(spark, network):
    """Given routes in order, with legs and four classes; a transfer that is too far; and every problem, all in one job."""
    from transit_spark.operators import chain

    stops, times, nodes = network["stops"], network["times"], network["nodes"]
    freq, profile = frequency.effective_frequency(times, ["pattern_id", "pos"]), frequency.running_profile(times)
    miles = stops.select("pattern_id", "pos", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), (F.col("pos") * 2.0)).alias("miles"))
    chains = {1: ["FAST", "BX"], 2: ["FREQ", "BX"], 3: ["NONE", "BX", "fast"], 4: ["BX"], 5: ["FREQ"], 6: ["FREQ", "C1"]}
    steps = spark.createDataFrame([(c, k, r, None) for c, names in chains.items() for k, r in enumerate(names)] + [(7, 0, "FAST", "nobody")], "chain_id int, step int, route string, agency string")
    here = spark.createDataFrame([(c, role, lat, -75.0) for c in range(1, 8) for role, lat in (("origin", 40.0), ("destination", 40.3))], "chain_id int, role string, lat double, lon double")
    run = lambda **more: chain.evaluate_chains(network["patterns"], stops, freq, profile, miles, nodes, steps, here, **more)
    ends, legs, problems = run(prices=Prices(mile=(0.0, 0.0, 0.0, 240.0)), transfer_walk=500.0)
    row = {r.chain_id: r for r in ends.collect()}
    assert set(row) == {1, 6} and row[1].rides == 2 and row[1].bottleneck == pytest.approx(1)
    mine = legs.where("chain_id = 1").orderBy("leg_no").collect()
    assert [x.kind for x in mine] == ["walk", "ride", "walk", "ride", "walk"] and [x.miles[3] for x in mine if x.kind == "ride"] == [2.0, 2.0]
    free = {r.chain_id: r.cost for r in run(prices=Prices(mile=(0.0, 0.0, 0.0, 0.0)))[0].collect()}
    assert row[1].cost - free[1] == pytest.approx(4 * 240)
    assert {(r.chain_id, r.problem) for r in problems.collect()} == {
        (2, "the routes do not connect in this order within the transfer walk limit"), (3, "no service found for route NONE"), (3, "no service found for route fast"), (4, "no stop of route BX within 800 m of the start"),
        (5, "no stop of route FREQ within 800 m of the end"), (7, "no service found for route FAST (nobody)")}
    routes, legs = chain.compare_chains(network["g"], spark.createDataFrame([(0, 1, 2)], "query_id int, origin bigint, destination bigint"))
    assert routes.count() == 1 and legs.where("kind = 'ride'").count() == 2


def test_steps_name_routes(spark):
    from transit_spark.functions.text import chain_step, chain_step_matches

    names = spark.createDataFrame([("8 Limited Express", "City Bus"), ("8", "x"), ("80", "x"), ("m1", "x"), ("M1", "x"), (None, "x"), ("", "x")], "name string, agency string")
    flag = lambda step: [r[0] for r in names.select(F.coalesce(chain_step_matches(F.col("name"), F.col("agency"), step), F.lit(False))).collect()]
    assert flag("8 Limited") == [True, False, False, False, False, False, False] and flag("8") == [True, True, False, False, False, False, False]
    assert flag("M1") == [False, False, False, False, True, False, False] and flag("city:8") == [True, False, False, False, False, False, False]
    tokens = spark.createDataFrame([("8",), ("NJ T:8",), ("a:b:c",)], "t string")
    assert [tuple(r[0]) for r in tokens.select(chain_step(F.col("t"), F.lit("dflt"))).collect()] == [("dflt", "8"), ("NJ T", "8"), ("a:b", "c")]


def test_nearest_each(spark):
    """Near, far and lonely points, ties, and keys that the other side lacks, against brute force."""
    import random

    rng = random.Random(2)
    place = lambda k, i, spread, off: (k, i, 40 + off + rng.uniform(0, spread), -75 + rng.uniform(0, spread))
    a = [place(k, i, 0.5, 0) for k in (1, 2) for i in range(60)] + [(1, 900, 43.0, -79.0), (3, 901, 40.0, -75.0), (2, 902, 40.0, -75.0)]
    b = [place(1, i, 0.5, 0) for i in range(1000, 1060)] + [place(2, i, 0.02, 3) for i in range(1000, 1300)] + [(2, 2000, 43.01, -75.0), (2, 1999, 43.01, -75.0)]
    frame = lambda rows: spark.createDataFrame(rows, "k int, node bigint, lat double, lon double")
    found = {(r.k, r.node): (r.near, r.dist) for r in walks.nearest_each(frame(a), frame(b), ["k"]).collect()}
    placed = {r: (r.x, r.y) for rows in (a, b) for r in walks._plane(frame(rows), "k").collect()}
    left, right = ([(r.k, r.node, *xy) for r, xy in placed.items() if (r.node >= 1000) == far] for far in (False, True))
    want = {}
    for k, node, x, y in left:
        near = sorted((((x - u) ** 2 + (y - w) ** 2) ** 0.5, n) for j, n, u, w in right if j == k)
        if near:
            want[k, node] = near[0]
    assert set(found) == set(want)
    for key, (dist, node) in want.items():
        assert found[key][1] == pytest.approx(dist) and (found[key][0] == node or found[key][1] == pytest.approx(dist))


def test_serving_options_of_the_priced_class(spark):
    """Two patterns serve a leg; with miles only the one of the leg's class does."""
    stops = spark.createDataFrame([(p, i, n, True, True) for p in (1, 2) for i, n in ((1, 10), (2, 20))], "pattern_id int, pos int, node bigint, board boolean, alight boolean")
    times = spark.createDataFrame([(p, 0, i, 100 * i + p, 100 * i + p) for p in (1, 2) for i in (1, 2)], "pattern_id int, trip_no int, pos int, dep int, arr int")
    miles = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [5.0, 1.0]), (2, 1, [9.0, 0.0]), (2, 2, [9.5, 3.0])], "pattern_id int, pos int, miles array<double>")
    legs = spark.createDataFrame([(0, 1, 10, 20, [0.2, 0.9])], "route_id int, leg_no int, u bigint, v bigint, miles array<double>")
    assert {r.pattern_id for r in replay.serving_options(legs, stops, times).collect()} == {1, 2}
    assert {r.pattern_id for r in replay.serving_options(legs, stops, times, miles).collect()} == {2}


def test_frequencies_table(spark, tmp_path):
    write_feed(tmp_path / "fq.zip", {"A": (40.0, -75.0), "B": (40.1, -75.0)}, {"R": (["A", "B"], [(8 * H, 600)])}, freqs=["R_0,07:00:00,09:00:00,600"])
    times = compiled(spark, tmp_path)[2].where("pos = 1")
    assert (times.count(), times.agg(F.min("dep")).first()[0]) == (12, 25200)


def test_stale_calendar(spark, tmp_path):
    write_feed(tmp_path / "old.zip", {"A": (40.0, -75.0), "B": (40.1, -75.0)}, {"R": (["A", "B"], [(8 * H, 600)])}, span="20250101,20250601")
    row = compiled(spark, tmp_path)[4].first()
    assert row.service_date.isoformat() <= "2025-06-01" and row.service_date.weekday() == 2 and row.note


def test_effective_frequency(spark):
    cases = {"hourly": range(6 * H, 22 * H, H), "one": [8 * H], "four": [6 * H, 6 * H + 1800, 7 * H, 7 * H + 1800], "late": [23 * H], "twice": [8 * H, 8 * H]}
    rows = spark.createDataFrame([(k, t) for k, v in cases.items() for t in v], "k string, dep int")
    found = {r.k: r.freq for r in frequency.effective_frequency(rows, ["k"]).collect()}
    assert found == pytest.approx({"hourly": 16, "one": 1, "four": 256 / 211, "late": 0, "twice": 1})


def test_hours(spark):
    read = lambda v: [tuple(x) for x in one(spark, text.parse_hours, v)]
    assert read("6:00am-6:30pm") == [(21600, 66600, None)]
    assert read("6:45am-5:12pm: every 90 min") == [(24300, 61920, 5400)]
    assert read("NO SERVICE") == [] and read(None) == []
    assert read("Mon 7 a.m. \u2013 11:30 A.M., 1pm-12:15 am; every 45 min") == [(25200, 41400, None), (46800, 900, 2700)]
    assert read("8am-9am 2 buses every 20 min") == [(28800, 32400, None)] and read("8am to 9am") == [] and read("8am - - 9am") == []


def test_scalars(spark):
    assert one(spark, text.parse_gtfs_time, " 25:00:01") == 90001 and one(spark, text.parse_gtfs_time, "x") is None and one(spark, text.parse_gtfs_time, None) is None
    assert one(spark, text.norm_url, "HTTPS://www.A.com/x//") == "a.com/x" and one(spark, text.norm_name, "Bus Co. (NJ) & Sons") == "bus co sons"
    assert one(spark, text.parse_gtfs_date, "20260230") is None


def test_density(spark):
    hops = [0.2] * 10 + [0.4] * 5 + [5.0] * 3
    rows = spark.createDataFrame([("p", i, h) for i, h in enumerate(hops)], "p string, pos int, miles double")
    found = [r.cls for r in locality.stop_density_class(rows, ["p"]).orderBy("pos").collect()]
    assert found[:8] == [0] * 8 and found[11:15] == [1] * 4 and found[15:] == [2] * 3


def test_local_preference(spark):
    schema = "u bigint, v bigint, freq double, time double, miles array<double>, dist double, zone_id bigint"
    g = search.Network(spark.createDataFrame([(1, 2, 32.0, 600.0, [0.0, 0.0, 2.0], None, None), (1, 3, 32.0, 400.0, [1.0, 0.0, 0.0], None, None), (3, 2, 32.0, 400.0, [1.0, 0.0, 0.0], None, None)], schema), spark.createDataFrame([], "u bigint, v bigint, time double, dist double"))
    ask = spark.createDataFrame([(0, 1, 2, 0.0)], "query_id int, origin bigint, destination bigint, threshold double")
    free = Prices(mile=(0.0, 0.0, 0.0))
    assert search.best_routes(g, ask, free)[1].count() == 1
    assert search.best_routes(g, ask, LOCAL)[1].count() == 2


def test_flex(spark):
    ring = [[(-75.0, 40.0), (-74.9, 40.0), (-74.9, 40.1), (-75.0, 40.1)]]
    service = {d: [(6 * H, 18 * H, None)] for d in range(5)}
    zones = spark.createDataFrame([("z", "Zone", "A", ring, service, "s"), ("ada", "ADA Paratransit", "A", ring, service, "s")], "zone_id string, name string, agency string, rings array<array<struct<lon: double, lat: double>>>, service map<int, array<struct<start: int, end: int, headway: int>>>, source string")
    nodes = spark.createDataFrame([(1, 40.05, -74.95), (2, 40.02, -74.92), (3, 40.05, -75.01), (4, 41.0, -75.0)], "node bigint, lat double, lon double")
    assert {(r.zone_id, r.node) for r in flex.zone_members(nodes, zones).collect()} == {(z, n) for z in ("z", "ada") for n in (1, 2)}
    rides, links, points = flex.flex_edges(nodes, zones, "2026-09-30")
    assert all(r.freq == pytest.approx(256 / 28) for r in rides.collect()) and rides.count() == 6 and links.count() == 2 and points.count() == 1
    ready = spark.createDataFrame([(0, "z", 2, 20 * H)], "k int, zone_id string, day0 int, ready bigint")
    windows = spark.createDataFrame([("z", d, 6 * H, 18 * H, None) for d in range(5)], "zone_id string, weekday int, start int, end int, headway int")
    assert replay.flex_pickup(ready, windows, ["k"]).first().pickup == 24 * H + 6 * H
    noon = spark.createDataFrame([(0, "z", 2, 12 * H)], "k int, zone_id string, day0 int, ready bigint")
    assert replay.flex_pickup(noon, windows, ["k"]).first().pickup == 12 * H + 1800  # half the usual headway, without one of its own
    names = ["City Paratransit", "ADA ride", "Access-a-Ride", "Mobility Link", "Dial-a-Ride", "Senior Shuttle", "Canada Line"]
    stated = spark.createDataFrame([(n, None) for n in names], "name string, agency string")
    assert {r.name for r in flex.open_zones(stated).collect()} == {"Dial-a-Ride", "Senior Shuttle", "Canada Line"}


def test_union_windows(spark):
    rows = spark.createDataFrame([("a", 0, 10, 1), ("a", 10, 20, 2), ("a", 30, 40, 3), ("b", 0, 50, 4), ("b", 5, 6, 5)], "k string, start int, end int, headway int")
    assert sorted(map(tuple, flex.union_windows(rows, ["k"]).collect())) == [("a", 0, 20, 1), ("a", 30, 40, 3), ("b", 0, 50, 4)]


def test_documents_round_trip(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"zone_id": "z", "name": "n"}, "geometry": {"type": "Polygon", "coordinates": [[[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]]}}
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature | {"geometry": {"type": "MultiPolygon", "coordinates": [[[[0.0, 1.0], [2.0, 3.0]]], [[[4.0, 5.0]]]]}}]}))
    rows = documents.read_zones(spark, str(tmp_path / "z.json")).collect()
    assert [len(r.rings) for r in rows] == [1, 2] and rows[0].rings[0][1].lon == 2.0
    documents.write_zones(documents.read_zones(spark, str(tmp_path / "z.json")), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["geometry"]["type"] == "MultiPolygon"


def test_all_queries_have_unique_names():
    from transit_spark.plans.queries import QUERIES

    assert set(SQL) <= set(QUERIES)
