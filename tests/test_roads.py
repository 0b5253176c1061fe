"""Road jobs on small cases with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from transit_spark.functions import roads as fr
from transit_spark.operators import roads


def test_lanes(spark):
    cases = [
        ({"highway": "primary", "lanes": "4"}, (0, 2, 2)), ({"highway": "primary", "lanes": "3"}, (0, 1, 1)), ({"highway": "primary", "lanes:forward": "2", "lanes:backward": "1"}, (0, 2, 1)),
        ({"highway": "primary", "oneway": "yes", "lanes": "3"}, (1, 3, 1)), ({"highway": "residential"}, (0, None, None)),
        ({"oneway": "yes", "lanes": "3", "lanes:forward": "2"}, (1, 3, 1)), ({"highway": "motorway", "oneway": "-1", "lanes": "2"}, (1, 2, 1)), ({"oneway": "-1", "lanes": "2.5;2"}, (-1, 1, 2.5)),
        ({"oneway": "-1"}, (-1, 1, None)), ({"oneway": "yes"}, (1, None, 1)), ({"oneway": "reverse", "lanes": "3"}, (0, 1, 1)), ({"lanes:backward": "2"}, (0, 2, 2)),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string, string>")
    found = rows.select("i", F.struct(*fr.lanes_by_direction(F.col("tags"))).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in found] == [x for _, x in cases]
    motor = spark.createDataFrame([({"highway": "motorway", "lanes": "3"},)], "tags map<string, string>").select(fr.lanes_by_direction(F.col("tags"))[0], fr.is_controlled(F.col("tags"))).first()
    assert tuple(motor) == (1, True)


@pytest.mark.parametrize(("given", "expected"), [
    ([0] * 20 + [1] * 3 + [0] * 20, [0] * 43), ([0] * 15 + [1] * 13 + [0] * 15, [0] * 15 + [1] * 13 + [0] * 15), ([-1, -1, 2, 2, -1, 1, 1], [2, 2, 2, 2, 2, 1, 1]),
])
def test_smoothing(spark, given, expected):
    rows = spark.createDataFrame([("s", i, 20.0, c) for i, c in enumerate(given)], "s string, piece_no int, length double, cls int")
    assert [r.cls for r in roads.smooth_classes(rows, ["s"]).orderBy("piece_no").collect()] == expected


def test_alignment_against_brute_force(spark):
    rng = np.random.default_rng(1)
    stops = pd.DataFrame({"pattern_id": "p", "shape_id": "s", "pos": np.arange(1, 5, dtype=np.int32), "x": rng.random(4) * 100, "y": rng.random(4) * 100})
    points = pd.DataFrame({"shape_id": "s", "point_no": np.arange(9, dtype=np.int32), "x": rng.random(9) * 100, "y": rng.random(9) * 100})
    found = roads.align_stops(spark.createDataFrame(stops), spark.createDataFrame(points)).orderBy("pos").toPandas().point_no.tolist()
    far = np.hypot(stops.x.to_numpy()[:, None] - points.x.to_numpy(), stops.y.to_numpy()[:, None] - points.y.to_numpy())
    cost = lambda c: sum(far[i, j] for i, j in enumerate(c))
    best = min((cost((a, b, c, d)) for a in range(9) for b in range(a, 9) for c in range(b, 9) for d in range(c, 9)))
    assert found == sorted(found) and cost(found) == pytest.approx(best)


def test_out_and_back(spark):
    x = [*range(0, 1001, 20), *range(980, -1, -20)]
    points = spark.createDataFrame([("s", i, float(v), 0.0) for i, v in enumerate(x)], "shape_id string, point_no int, x double, y double")
    stops = spark.createDataFrame([("p", "s", i, float(v), 5.0) for i, v in enumerate((0, 500, 1000, 500, 0))], "pattern_id string, shape_id string, pos int, x double, y double")
    found = roads.align_stops(stops, points).orderBy("pos").collect()
    assert [r.point_no for r in found] == [0, 25, 50, 75, 100] and found[0].median_offset <= 5


def way(i, a, b, cls, oneway=0, off=False):
    return (i, [a, b], cls, cls, oneway, "tagged", off)


def classes(spark, ways, line):
    index = spark.createDataFrame(ways, "way_id bigint, nodes array<struct<lat: double, lon: double>>, cls_f int, cls_b int, oneway int, source string, off_grade boolean")
    shape = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(line)], "shape_id string, seq int, lat double, lon double")
    pieces = roads.resample_shapes(shape)
    found = roads.match_to_roads(pieces, roads.road_pieces(index))
    return {r.cls for r in found.collect() if r.cls >= 0}


def test_matching(spark):
    freeway, street = way(1, (40.0, -75.02), (40.0, -74.98), 3), way(2, (39.98, -75.0), (40.02, -75.0), 0)
    assert classes(spark, [freeway, street], [(39.985, -75.0), (40.015, -75.0)]) == {0}
    assert classes(spark, [freeway, street], [(40.0, -75.015), (40.0, -74.985)]) == {3}
    east, west = way(3, (40.01, -75.02), (40.01, -74.98), 2, 1), way(4, (40.01013, -74.98), (40.01013, -75.02), 1, 1)
    assert classes(spark, [east, west], [(40.01, -75.01), (40.01, -74.99)]) == {2}
    assert classes(spark, [east, west], [(40.01013, -74.99), (40.01013, -75.01)]) == {1}
    tunnel, over = way(5, (40.03, -75.02), (40.03, -74.98), 3, 0, True), way(6, (40.030054, -75.02), (40.030054, -74.98), 0)
    assert classes(spark, [tunnel, over], [(40.03, -75.01), (40.03, -74.99)]) == {0}
    assert classes(spark, [tunnel], [(40.03, -75.01), (40.03, -74.99)]) == {3}


def test_road_classes_of_patterns(spark):
    """A freeway and a looping street between the same stops: each pattern has its miles on its own road; one without a shape falls back."""
    ends = ((40.0, -75.04), (40.0, -75.0))
    ways_ = [way(1, *ends, 3), way(2, ends[0], (40.02, -75.04), 0), way(3, (40.02, -75.04), (40.02, -75.0), 0), way(4, (40.02, -75.0), ends[1], 0)]
    index = spark.createDataFrame(ways_, "way_id bigint, nodes array<struct<lat: double, lon: double>>, cls_f int, cls_b int, oneway int, source string, off_grade boolean")
    loop = [ends[0], (40.02, -75.04), (40.02, -75.0), ends[1]]
    shapes = spark.createDataFrame([(s, i, a, b) for s, line in (("F", ends), ("L", loop)) for i, (a, b) in enumerate(line)], "shape_id string, seq int, lat double, lon double")
    from transit_spark.functions.geo import project

    stops = spark.createDataFrame([(p, s, i + 1, *ends[i]) for p, s in ((1, "F"), (2, "L"), (3, None)) for i in (0, 1)], "pattern_id int, shape_id string, pos int, lat double, lon double")
    x, y = project(F.col("lat"), F.col("lon"))
    density = spark.createDataFrame([(p, i, [float(i - 1), 0.0, 0.0]) for p in (1, 2, 3) for i in (1, 2)], "pattern_id int, pos int, miles array<double>")
    rows = roads.classify_patterns(stops.select("pattern_id", "shape_id", "pos", x.alias("x"), y.alias("y")), shapes, roads.road_pieces(index), density)
    found = {(r.pattern_id, r.pos): (r.miles, r.fallback) for r in rows.collect()}
    assert found[1, 2][0][3] == pytest.approx(2.117, abs=0.05) and sum(found[1, 2][0][:3]) < 0.1 and not found[1, 2][1]
    assert found[2, 2][0][0] == pytest.approx(4.88, abs=0.1) and found[2, 2][0][3] < 0.1
    assert found[3, 2] == ([1.0, 0.0, 0.0, 0.0], True) and found[1, 1][0] == [0.0] * 4


def test_shape_between_two_carriageways(spark):
    """A shape drawn midway takes the carriageway of its direction, either way."""
    east, west = way(3, (40.01, -75.02), (40.01, -74.98), 2, 1), way(4, (40.01013, -74.98), (40.01013, -75.02), 1, 1)
    assert classes(spark, [east, west], [(40.010065, -75.01), (40.010065, -74.99)]) == {2}
    assert classes(spark, [east, west], [(40.010065, -74.99), (40.010065, -75.01)]) == {1}


def test_aligned_stops_query_against_brute_force(spark):
    """Every pattern of the registered query has the least summed distance that rising point numbers allow."""
    from transit_spark.plans import queries, views

    sf = "/root/testdata/sf0.001"
    found = queries.aligned_stops(spark, sf).toPandas().sort_values(["pattern_id", "pos"])
    stops = dict(list(queries._shape_stops(spark, sf).where("shape_id is not null").toPandas().sort_values("pos").groupby("pattern_id")))
    points = dict(list(roads.resample_shapes(views.shape_points(spark, sf), 50.0).toPandas().sort_values("piece_no").groupby("shape_id")))
    assert set(found.pattern_id) == {p for p in stops if p in points} and len(found) > 1000
    for pattern, own in found.groupby("pattern_id"):
        at, line = stops[pattern], points[pattern]
        far = np.hypot(at.x.to_numpy()[:, None] - line.x0.to_numpy(), at.y.to_numpy()[:, None] - line.y0.to_numpy())
        least = far[0]
        for row in far[1:]:
            least = np.array([row[p] + least[: p + 1].min() for p in range(len(row))])
        chosen = own.point_no.to_numpy()
        assert len(own) == len(at) and (np.diff(chosen) >= 0).all()
        assert far[np.arange(len(at)), chosen].sum() == pytest.approx(least.min())
