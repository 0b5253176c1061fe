"""What tasks hold and what steps send: as much as the rows need, once."""

import pytest
from pyspark.sql import functions as F

from transit_spark.operators import chain, replay, roads, search


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr("transit_spark.checkpoint.TASK_ROWS", 10, raising=False)


def test_shapes_are_dealt_by_their_points(spark, small_tasks):
    shapes = spark.range(200).selectExpr("id div 4 as shape_id", "id % 4 as seq", "40.6 + id % 4 * 0.001 as lat", "-75.0D as lon")
    assert roads.resample_shapes(shapes, 100.0).rdd.getNumPartitions() >= 20


def test_runs_are_dealt_by_their_pieces(spark, small_tasks):
    pieces = spark.range(200).selectExpr("id div 4 as shape_id", "id % 4 as piece_no", "cast(id % 3 as int) as cls", "20.0D as length")
    assert roads.smooth_classes(pieces, ["shape_id"]).rdd.getNumPartitions() >= 20


def test_ready_times_are_sent_once_an_option(spark):
    """Not once for each of four days: a trip of the next day, one after midnight, and none."""
    options = spark.createDataFrame([(1, 1, 1, 1, 600, 900), (1, 1, 2, 2, 90000, 90300)], "route_id int, leg_no int, pattern_id int, trip_no int, dep int, arr int")
    ready = spark.createDataFrame([(1, 1, 1, 700), (2, 1, 1, 3000), (3, 1, 1, 86400 + 3700), (4, 2, 1, 0)], "k int, route_id int, leg_no int, ready int")
    found = replay.next_trip(ready, options, ["k"])
    assert {r.k: (r.pattern_id, r.dep) for r in found.collect()} == {1: (2, 3600), 2: (2, 3600), 3: (1, 172800 + 600)}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_times_of_trips_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, 1, p, 100 * p, 100 * p - 20) for p in range(3)], "pattern_id int, trip_no int, pos int, dep int, arr int").write.parquet(str(tmp_path / "times"))
    legs = spark.createDataFrame([(1, 1, 5, 7)], "route_id int, leg_no int, u int, v int")
    stops = spark.createDataFrame([(1, p, 5 + p, True, True) for p in range(3)], "pattern_id int, pos int, node int, board boolean, alight boolean")
    found = replay.serving_options(legs, stops, spark.read.parquet(str(tmp_path / "times")))
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, 1, 0, 180)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_searches_leave_out_what_no_route_needs(spark):
    """A reversed pass ends at its reach; rides below every threshold aren't priced; fewer frequent rides are tried only where they are needed."""
    rides = [(i, i + 1, float(f), 60.0, [0.0], None, None) for i in range(6) for f in (50 if i != 4 else 8, 2)] + [(0, 3, 4.0, 60.0, [0.0], None, None)]
    g = search.Network(spark.createDataFrame(rides, "u bigint, v bigint, freq double, time double, miles array<double>, dist double, zone_id bigint"), spark.createDataFrame([], "u bigint, v bigint, time double, dist double"))
    wide = search.max_bottleneck(g, spark.createDataFrame([(0,), (5,)], "origin bigint")).collect()
    assert {(r.origin, r.node): r.freq for r in wide} == {(0, 0): float("inf"), (0, 1): 50.0, (0, 2): 50.0, (0, 3): 50.0, (0, 4): 50.0, (0, 5): 8.0, (0, 6): 8.0, (5, 5): float("inf"), (5, 6): 50.0}
    goals = spark.createDataFrame([(1, 6, 1000.0)], "goal int, destination bigint, reach double")
    near = {r.node: r.ahead for r in search.cheapest_ahead(g, goals).collect()}
    whole = {r.node: r.ahead for r in search.cheapest_ahead(g, goals.drop("reach")).collect()}
    assert set(near) == {6, 5, 4} and near[4] == 1000.0 < whole[4] and near[5] == whole[5] and len(whole) == 7
    from transit_spark.config import Prices

    assert {r.freq for r in search.priced_rides(g, Prices(), 5.0).select(F.col("freq")).collect()} == {50.0, 8.0}


def test_chains_write_no_walk_between_two_stops(spark, monkeypatch):
    """200 stops at one place are left and boarded: no table has all pairs of them; legs and cost are those of one stop. Rides stay dealt for the next round."""
    there = list(range(100, 300))
    way = [(1, 0, 1, True, False)] + [(1, i + 1, n, False, True) for i, n in enumerate(there)] + [(2, i, n, True, False) for i, n in enumerate(there)] + [(2, 200, 2, False, True)]
    stops = spark.createDataFrame(way, "pattern_id int, pos int, node bigint, board boolean, alight boolean")
    nodes = spark.createDataFrame([(1, 40.0), (2, 40.3), *[(n, 40.1) for n in there]], "node bigint, lat double").withColumn("lon", F.lit(-75.0))
    freq = stops.select("pattern_id", "pos", F.lit(8.0).alias("freq"))
    profile = stops.select("pattern_id", "pos", (F.col("pos") * 60.0).alias("dep_med"), (F.col("pos") * 60.0).alias("arr_med"))
    miles = stops.select("pattern_id", "pos", F.array(*[F.lit(0.0)] * 3).alias("miles"))
    patterns = spark.createDataFrame([(1, "A", "x"), (2, "B", "x")], "pattern_id int, route_name string, agency string")
    steps = spark.createDataFrame([(7, 0, "A", None), (7, 1, "B", None)], "chain_id int, step int, route string, agency string")
    ends = spark.createDataFrame([(7, "origin", 40.0, -75.0), (7, "destination", 40.3, -75.0)], "chain_id int, role string, lat double, lon double")
    sizes, cut = [], chain.cut
    monkeypatch.setattr(chain, "cut", lambda df: (out := cut(df), sizes.append(out.count()))[0])
    out, legs, problems = chain.evaluate_chains(patterns, stops, freq, profile, miles, nodes, steps, ends)
    assert problems.count() == 0 and max(sizes) <= 2000
    found = legs.orderBy("leg_no").collect()
    assert [(r.kind, r.time) for r in found] == [("walk", 1.0), ("ride", 60.0), ("walk", 1.0), ("ride", 60.0), ("walk", 1.0)]
    assert (found[0].u, found[1].u, found[1].v, found[2].u, found[2].v, found[3].u, found[3].v) == (1, 1, 100, 100, 299, 299, 2)
    assert out.collect()[0].rides == 2 and out.collect()[0].bottleneck == 8.0
