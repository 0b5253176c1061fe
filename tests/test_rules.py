"""Rules that are easy to get wrong, each with the value that is right; sources and documents."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from transit_spark.config import BUS_HIGHWAYS, EXCLUDED_AGENCIES
from transit_spark.operators import catalog, flex, locality, report, roads, timetable
from transit_spark.sources import documents, gtfs

H = 3600
ZONE = "zone_id string, name string, agency string, rings array<array<struct<lon: double, lat: double>>>, service map<int, array<struct<start: int, end: int, headway: int>>>, source string"


def square(lon, lat, side=0.02):
    return [[(lon, lat), (lon + side, lat), (lon + side, lat + side), (lon, lat + side)]]


def test_services_are_counted_in_the_window(spark):
    """A service with three departures before six and none in the window isn't listed, however many it has."""
    options = spark.createDataFrame([(1, 1, p, d) for p, d in ((1, 4 * H), (1, 5 * H), (1, 5 * H + 60), (2, 8 * H), (3, 9 * H), (3, 9 * H))], "route_id int, leg_no int, pattern_id int, dep int")
    patterns = spark.createDataFrame([(1, "early", "1"), (2, "day", "2"), (3, "day", "3")], "pattern_id int, agency string, route_name string")
    row = report.ride_stats(options, patterns).first()
    assert (row.in_window, row.all_day) == (2, 5) and [(s.route_name, s.n) for s in row.services] == [("3", 2), ("2", 1)]


def test_operators_names_belong_together(spark):
    files = [{"feeds": [{"id": "f1", "spec": "gtfs", "operators": [{"name": "Below"}]}, {"id": "f2", "spec": "gtfs"}], "operators": [{"name": "Op Name", "associated_feeds": [{"feed_onestop_id": "f1"}]}]},
             {"feeds": [{"id": "f1", "spec": "gtfs"}], "operators": [{"name": "A"}, {"name": "B"}]}]
    rows = catalog.flatten_atlas(spark.createDataFrame([json.dumps(f) for f in files], "string").select(F.from_json("value", documents.ATLAS).alias("r")).select("r.*")).collect()
    assert sorted((r.onestop_id, r.operators) for r in rows) == [("f1", []), ("f1", ["Below", "Op Name"]), ("f2", ["Op Name"])]


def test_a_copy_without_a_box_is_accepted(spark):
    box = "struct<south: double, west: double, north: double, east: double>"
    stale = spark.createDataFrame([(1, (40.0, -75.0, 40.1, -74.9)), (2, None), (3, (40.0, -75.0, 40.1, -74.9))], f"feed_id int, bbox {box}")
    copies = spark.createDataFrame([(1, 1, "u1", "l", False, None), (2, 1, "u2", "l", False, (40.0, -75.0, 40.1, -74.9)), (2, 2, "u3", "l", True, None), (3, 1, "u4", "l", True, (50.0, -75.0, 50.1, -74.9))], f"feed_id int, order int, url string, label string, by_url boolean, bbox {box}")
    copies = copies.withColumns({"service_start": F.lit("2026-01-01"), "service_end": F.lit("2027-01-01")})
    assert {r.feed_id: r.url for r in catalog.pick_fresh(stale, copies, "2026-09-30").collect()} == {1: "u1", 2: "u3"}


def test_exclusions_hold_by_default(spark):
    feeds = spark.createDataFrame([(1, "Local Bus", "", "active"), (2, "Peter  Pan Lines", "", "active"), (3, "City", "Light Rail", "active"), (4, "Empath Transit", "", "active"), (5, "PATH", "", "active")], "feed_id int, provider string, feed_name string, status string")
    feeds = feeds.withColumns({"url": F.lit("u"), "service_end": F.lit("2027-01-01"), "bbox": F.lit(None).cast("struct<south: double, west: double, north: double, east: double>")})
    reasons = {r.feed_id: r.reason for r in catalog.select_feeds(feeds, "2026-09-30").collect()}
    assert reasons == {1: None, 2: "provider excluded (not fixed-fare local bus)", 3: "feed name excluded (rail/ferry/flex)", 4: None, 5: "provider excluded (not fixed-fare local bus)"}
    routes = spark.createDataFrame([("f", 1, "a", "1", "3.0"), ("f", 2, "b", "2", "3"), ("f", 3, "a", "3", "3.5"), ("f", 4, "a", "4", "x")], "feed_id string, row_no int, agency_id string, route_id string, route_type string").withColumns({"route_short_name": F.col("route_id"), "route_long_name": F.lit("")})
    agency = spark.createDataFrame([("f", 1, "a", "City"), ("f", 2, "b", "MegaBus")], "feed_id string, row_no int, agency_id string, agency_name string")
    named = spark.createDataFrame([("f", "p")], "feed_id string, provider string")
    assert [r.route_id for r in timetable.bus_routes(routes, agency, named).collect()] == ["1"] and r"megabus" in EXCLUDED_AGENCIES
    assert BUS_HIGHWAYS[-3:] == ("busway", "bus_guideway", "road")


def test_numbers_may_have_decimals(spark):
    times = spark.createDataFrame([("f", i, "t", s, q, t, t) for i, (s, q, t) in enumerate([("b", "2.0", "08:10:00"), ("a", "1.0", "08:00:00"), ("c", "2.5", "08:20:00"), ("d", "x", "08:30:00"), ("d", "nan", "08:30:00")])], "feed_id string, row_no int, trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string").withColumns({"pickup_type": F.lit(None).cast("string"), "drop_off_type": F.lit(None).cast("string")})
    stops = spark.createDataFrame([("f", s) for s in "abcd"], "feed_id string, stop_id string")
    trips = spark.createDataFrame([("f", "t")], "feed_id string, trip_id string")
    rows = timetable.clean_stop_times(times, trips, stops)
    assert [(r.pos, r.stop_id) for r in rows.orderBy("pos").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    freq = spark.createDataFrame([("f", "t", "06:00:00", "06:30:00", "600.5"), ("f", "t", "07:00:00", "07:00:00", "60")], "feed_id string, trip_id string, start_time string, end_time string, headway_secs string")
    copies = timetable.expand_frequencies(rows, freq).where("pos = 1").orderBy("dep").collect()
    assert [r.dep for r in copies] == [21600, round(22200.5), 22801]


def test_short_hops_count_as_they_are(spark):
    """Three visits to one stop are no miles; a hop is floored for the density alone."""
    stops = spark.createDataFrame([(1, p, n, True, True) for p, n in ((1, 1), (2, 1), (3, 1), (4, 2))], "pattern_id int, pos int, node int, board boolean, alight boolean")
    nodes = spark.createDataFrame([(1, 40.0, -75.0), (2, 40.1, -75.0)], "node int, lat double, lon double")
    miles = {r.pos: r.miles for r in locality.stop_density_miles(stops, nodes).collect()}
    assert sum(miles[3]) == 0.0 and sum(miles[4]) == pytest.approx(math.radians(0.1) * 6371000 / 1609.344)


def test_zones_of_a_feed(spark):
    """Named after feed and location, the short or else the long name of the first row's route; a window that ends before it begins stays."""
    times = spark.createDataFrame([(9, 2, "t2", "z", "08:00:00", "07:00:00"), (9, 1, "t1", "z", "10:00:00", "12:00:00"), (9, 3, "t1", "z", "11:00:00", "13:00:00"), (9, 4, "t3", "y", "x", "13:00:00"), (9, 5, "t3", "w", "06:00:00", "07:00:00")], "feed_id int, row_no int, trip_id string, location_id string, start_pickup_drop_off_window string, end_pickup_drop_off_window string")
    trips = spark.createDataFrame([(9, "t1", "r1"), (9, "t2", "r2"), (9, "t3", "r3")], "feed_id int, trip_id string, route_id string")
    routes = spark.createDataFrame([(9, "r1", "", "Long ", "A"), (9, "r2", "2", "x", "B"), (9, "r3", None, None, "C")], "feed_id int, route_id string, route_short_name string, route_long_name string, agency string")
    places = spark.createDataFrame([(9, "z"), (9, "y"), (9, "w")], "feed_id int, location_id string").withColumn("rings", F.array())
    rows = {r.zone_id: r for r in flex.gtfs_flex_zones(times, trips, routes, places, "2026-09-30").collect()}
    assert set(rows) == {"9-z", "9-w"} and rows["9-w"].name == "w" and (rows["9-z"].name, rows["9-z"].agency, rows["9-z"].source) == ("Long", "A", "9")
    assert [tuple(w)[:2] for w in rows["9-z"].service[2]] == [(8 * H, 7 * H), (10 * H, 13 * H)]
    legs = spark.createDataFrame([(1, "flex", "9-z"), (1, "flex", "layer zone")], "route_id int, kind string, zone_id string")
    zones = spark.createDataFrame([("9-z", "9"), ("layer zone", "a map")], "zone_id string, source string")
    manifest = spark.createDataFrame([("9", True, "2026-05-31T00:00"), ("f", False, None)], "feed_id string, stale boolean, service_end string")
    options, patterns = spark.createDataFrame([(1, 5)], "route_id int, pattern_id int"), spark.createDataFrame([(5, "f")], "pattern_id int, feed_id string")
    assert {tuple(r) for r in report.route_feeds(legs, options, patterns, zones, manifest).select("route_id", "feed_id", "note").collect()} == {(1, "9", "calendar ended 2026-05-31"), (1, "f", None)}


def test_closed_zones_add_nothing(spark):
    """A zone without service on the day has no rides, walks or edge points."""
    open_, shut = {2: [(6 * H, 20 * H, None)]}, {3: [(6 * H, 20 * H, None)]}
    zones = spark.createDataFrame([("open", "n", "a", square(-75.0, 40.0), open_, "s"), ("shut", "n", "a", square(-74.0, 40.0), shut, "s")], ZONE)
    nodes = spark.createDataFrame([(1, 40.01, -74.99), (2, 40.015, -74.985), (3, 40.01, -74.975), (11, 40.01, -73.99), (12, 40.015, -73.985), (13, 40.01, -73.975)], "node bigint, lat double, lon double")
    rides, links, points = flex.flex_edges(nodes, zones, "2026-09-30")
    assert {r.zone_id for r in rides.collect()} == {"open"} and {r.zone_id for r in points.collect()} == {"open"} and not {r.u for r in links.collect()} & {11, 12, 13} and links.count() == 2


def test_a_polygon_of_many_sides(spark):
    """Nodes meet the sides of their row or cell; members and distances are those of the circle that the polygon draws, at each size."""
    for n in (50, 100_000):
        ring = [(-75 + 0.1 * math.cos(2 * math.pi * i / n), 40 + 0.1 * math.sin(2 * math.pi * i / n)) for i in range(n)]
        zones = spark.createDataFrame([("c", "n", "a", [ring], None, "s")], ZONE)
        at = [(i, 40 + r * math.sin(i), -75 + r * math.cos(i)) for i, r in enumerate((0.0, 0.05, 0.09, 0.095, 0.105, 0.11, 0.12, 0.2))]
        nodes = spark.createDataFrame(at, "node bigint, lat double, lon double")
        assert {r.node for r in flex.zone_members(nodes, zones).collect()} == {0, 1, 2, 3}
        near = {r.node: r.dist for r in flex.nearest_boundary(nodes, zones).collect()}
        assert set(near) == {4, 5, 6} and all(350 < near[k] < 2500 for k in near) and near[4] < near[5] < near[6]


def test_nearest_boundary_of_long_sides(spark):
    """Sides that cross many cells, level, upright and slanting, against every side."""
    ring = [(-75.0, 40.0), (-74.0, 40.0), (-74.0, 40.8), (-74.6, 40.3)]
    zones = spark.createDataFrame([("z", "n", "a", [ring], None, "s")], ZONE)
    at = [(i * 100 + j, 39.97 + i * 0.04, -75.03 + j * 0.05) for i in range(23) for j in range(23)]
    nodes = spark.createDataFrame(at, "node bigint, lat double, lon double")
    inside = {r.node for r in flex.zone_members(nodes, zones).collect()}
    near = {r.node: r.dist for r in flex.nearest_boundary(nodes, zones, 2500.0).collect()}
    k = math.cos(math.radians(40.6))
    plane = lambda lat, lon: (math.radians(lon) * 6371000 * k, math.radians(lat) * 6371000)
    corners = [plane(lat, lon) for lon, lat in ring]
    want = {}
    for node, lat, lon in at:
        x, y = plane(lat, lon)
        best = math.inf
        for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
            t = min(1, max(0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
            best = min(best, math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)))
        if best <= 2500 and node not in inside:
            want[node] = best
    assert near == pytest.approx(want) and len(want) > 20


def test_zones_round_trip_with_service(spark, tmp_path):
    zones = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0.0, 1.0], [2.0, 3.0, 9.0], [4.0, 5.0]]]}, "properties": {"zone_id": "a", "name": "A", "service": {"mon": [[21600, 64800, None], [70000, 71000, 900]], "sun": [[0, 10, 5]]}}},
             {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0.0, 1.0], [2.0, 3.0]]], [[[4.0, 5.0]]]]}, "properties": {"zone_id": "b", "name": "B"}}]
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": zones}))
    read = documents.read_zones(spark, str(tmp_path / "z.json"))
    documents.write_zones(read, str(tmp_path / "out"))
    for df in (read, documents.read_zones(spark, str(tmp_path / "out"), lines=True)):
        rows = {r.zone_id: r for r in df.collect()}
        assert {d: [tuple(w) for w in ws] for d, ws in rows["a"].service.items()} == {0: [(21600, 64800, None), (70000, 71000, 900)], 6: [(0, 10, 5)]}
        assert rows["b"].service == {} and [len(r.rings) for r in (rows["a"], rows["b"])] == [1, 2] and rows["a"].rings[0][1].lon == 2.0
    assert {r.zone_id: r.freq for r in flex.flex_frequency(read, "2026-10-05").collect()}.keys() == {"a"}  # a Monday


def feed_zip(stops, extra=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as files:
        files.writestr("x/stops.txt", "﻿ stop_id ,stop_name,color\n" + "".join(f"{s}, stop {s},red\n" for s in stops) + extra)
        files.writestr("routes.txt", "route_id\nr\n")
    return out.getvalue()


def test_feeds_are_unpacked_in_one_pass(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f1.zip").write_bytes(feed_zip(range(25_000), "1,2,3,4\n\n"))
    (tmp_path / "in/f2.zip").write_bytes(feed_zip(["a"]))
    tables = {"stops": ["stop_id", "stop_lat", "stop_name"], "routes": ["route_id"], "trips": ["trip_id"]}
    gtfs.unpack_feeds(spark, str(tmp_path / "in"), str(tmp_path / "out"), tables, ("stops",))
    stops = gtfs.read_unpacked(spark, str(tmp_path / "out"), "stops", tables)
    assert stops.count() == 25_001 and {(r.feed_id, r.row_no, r.stop_id, r.stop_lat, r.stop_name) for r in stops.where("stop_id in ('7', 'a')").collect()} == {("f1", 7, "7", "", "stop 7"), ("f2", 0, "a", "", "stop a")}
    assert gtfs.read_unpacked(spark, str(tmp_path / "out"), "trips", tables).count() == 0 and gtfs.read_unpacked(spark, str(tmp_path / "out"), "routes", tables).count() == 2
    one = gtfs.read_gtfs_table(spark, str(tmp_path / "in"), "stops", ["stop_id", "stop_lat", "stop_name"])
    assert one.exceptAll(stops).count() == 0 == stops.exceptAll(one).count()
    with pytest.raises(Exception, match="trips.txt"):
        gtfs.read_gtfs_table(spark, str(tmp_path / "in"), "trips", ["trip_id"]).count()


def test_compiled_timetables_are_used_again(spark, tmp_path):
    """A second run over the same datasets writes nothing; new data, another date or another version is compiled, and other feeds stay."""
    path = str(tmp_path / "tt")
    feeds = lambda *rows: spark.createDataFrame([(*r, "2026-09-30") for r in rows], "feed_id string, dataset_id string, service_date string, target string").withColumn("service_date", F.to_date("service_date"))
    table = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "feed_id string, pattern_id int")
    first = feeds(("a", "d1", "2026-09-30"), ("b", "d1", "2026-09-30"))
    assert gtfs.feeds_to_compile(spark, first, path).count() == 2
    gtfs.write_timetable(first, *[table("a", "b")] * 3, path)
    assert gtfs.feeds_to_compile(spark, first, path).count() == 0 and gtfs.feeds_to_compile(spark, first, path, 2).count() == 2
    again = gtfs.feeds_to_compile(spark, feeds(("a", "d2", "2026-09-23"), ("b", "d1", "2026-09-30")), path)
    assert [r.feed_id for r in again.collect()] == ["a"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "tt").rglob("*.parquet") if "feed_id=b" in str(p)}
    gtfs.write_timetable(again, *[table("a", "a")] * 3, path)
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert {(r.feed_id, str(r.service_date)) for r in spark.read.parquet(f"{path}/patterns").collect()} == {("a", "2026-09-23"), ("a", "2026-09-30"), ("b", "2026-09-30")}


def test_route_documents(spark, tmp_path):
    """One document a question: routes by rank, legs in order, connections, summary; and a feature collection of its legs."""
    end = "struct<name: string, lon: double, lat: double>"
    legs = spark.createDataFrame([(1, 1, "second", 1, "ride", ("a", 1.0, 2.0), ("b", 3.0, 4.0), [("x", "8"), ("y", "9")], 600.0), (1, 0, "first", 2, "walk", ("b", 3.0, 4.0), ("c", 5.0, 6.0), None, None), (1, 0, "first", 1, "flex", ("a", 1.0, 2.0), ("b", 3.0, 4.0), [("z", "on demand")], 3600.0)],
                                 f"query_id int, rank int, label string, leg_no int, kind string, `from` {end}, `to` {end}, services array<struct<agency: string, route: string>>, headway double")
    doc = json.loads(documents.route_features(legs).first().value)
    assert doc["type"] == "FeatureCollection" and [f["properties"]["route_rank"] for f in doc["features"]] == [0, 0, 1]
    assert doc["features"][0]["properties"] == {"route_rank": 0, "route_label": "first", "kind": "flex", "from": "a", "to": "b", "services": "z on demand", "effective_headway_s": 3600.0}
    assert "services" not in doc["features"][1]["properties"] and doc["features"][2]["properties"]["services"] == "x 8, y 9" and doc["features"][2]["geometry"] == {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}
    runs = spark.createDataFrame([(1, [21600, 79200], 800.0), (2, [21600, 79200], 900.0)], "query_id int, window array<int>, max_walk_m double")
    profile = spark.createDataFrame([(1, 0, 200, 300), (1, 0, 100, 250)], "query_id int, rank int, dep int, arr int")
    feeds = spark.createDataFrame([(1, 0, "g"), (1, 0, "f")], "query_id int, rank int, feed_id string")
    docs = documents.route_documents(runs, legs.select("query_id", "rank", "label").distinct(), legs.select("query_id", "rank", "leg_no", "kind"), profile, feeds)
    documents.write_documents(docs, str(tmp_path / "docs"))
    one = json.loads(spark.read.text(str(tmp_path / "docs/query_id=1")).first().value)
    assert one["window"] == [21600, 79200] and [r["label"] for r in one["routes"]] == ["first", "second"] and [x["kind"] for x in one["routes"][0]["legs"]] == ["flex", "walk"]
    assert one["routes"][0]["connections"] == [[100, 250], [200, 300]] and one["routes"][0]["profile"] == {"connections": 2, "min_duration_s": 100, "median_duration_s": 125, "max_duration_s": 150} and one["routes"][0]["feeds"] == ["f", "g"]
    assert one["routes"][1]["profile"] == {"connections": 0} and one["routes"][1]["connections"] == []


def test_ways_by_lane_source(spark):
    rows = roads.way_coverage(spark.createDataFrame([("tagged",), ("tagged",), ("same street",), ("street type",)], "source string")).collect()
    assert {r.source: (r.ways, r.share) for r in rows} == {"tagged": (2, 0.5), "same street": (1, 0.25), "street type": (1, 0.25)}
