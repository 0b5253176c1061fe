"""Road classes of patterns: pieces are matched as row by row, and none is stored."""

import os

import numpy as np
from pyspark.sql import functions as F

from transit_spark.checkpoint import cut
from transit_spark.functions.geo import project, unproject
from transit_spark.operators import roads

INDEX = "way_id string, piece string, x0 double, y0 double, x1 double, y1 double, cls_f int, cls_b int, oneway int, source string, off_grade boolean"


def _lines(spark, shapes):
    x, y = project(F.col("lat"), F.col("lon"))
    rows = shapes.groupBy("shape_id").agg(F.sort_array(F.collect_list(F.struct("seq", x.alias("x"), y.alias("y")))).alias("p"))
    return rows.select("shape_id", "p.x", "p.y")


def _cases(spark, rng):
    """Shapes that cross several tiles, with points that repeat or are unknown, among roads of which some coincide or score alike."""
    at = np.cumsum(rng.normal(0, 260, (40, 12, 2)), axis=1) + np.array([-6.36e6, 4.51e6])
    at[3, 4] = at[3, 3]
    at[7, :] = at[7, 0]
    at[9, 1:6] = at[9, 0] + [[5e3, 0], [5e3, 0.005], [5e3, 0.009], [0, 0], [0, 900]]
    points = [(f"s{i}", k, float(x), float(y)) for i, line in enumerate(at) for k, (x, y) in enumerate(line)]
    points = [(*p[:2], None, None) if p[:2] == ("s5", 6) else p for p in points]
    lat, lon = unproject(F.col("x"), F.col("y"))
    shapes = spark.createDataFrame(points, "shape_id string, seq int, x double, y double").select("shape_id", "seq", lat.alias("lat"), lon.alias("lon"))
    index = []
    for i, line in enumerate(at):
        for k, ((x, y), (u, v)) in enumerate(zip(line, line[1:], strict=False)):
            n = max(1, int(np.ceil(np.hypot(u - x, v - y) / 40)))
            for j in range(n if (i + k) % 5 and np.hypot(u - x, v - y) > 0.01 else 0):
                end = [*(np.array([x, y]) + np.array([u - x, v - y]) * j / n), *(np.array([x, y]) + np.array([u - x, v - y]) * (j + 1) / n)]
                moved = (np.array(end) + np.tile(rng.integers(-20, 21, 2), 2)).tolist()
                index += [(f"w{m * 7 % 10}-{i}", f"{k}-{j}", *moved, int(rng.integers(0, 4)), int(rng.integers(0, 4)), int(rng.integers(-1, 2)) if m else 0, "tagged", bool(m == 2)) for m in range(3)]
    return shapes, spark.createDataFrame(index, INDEX)


def test_lines_match_as_their_pieces_do(spark, monkeypatch):
    monkeypatch.setattr(roads, "MATCHED", 40)  # tiles are dealt to many tasks
    shapes, index = (cut(df) for df in _cases(spark, np.random.default_rng(5)))
    want = {(r.shape_id, r.piece_no): r.cls for r in roads.match_to_roads(roads.resample_shapes(shapes), index).collect()}
    found, runs = {}, roads.matched_lines(_lines(spark, shapes), index).collect()
    for r in runs:
        for j, c in enumerate(np.frombuffer(r.cls, dtype=np.int8)):
            assert found.setdefault((r.shape_id, r.k + j), int(c)) == c
    assert found == want and len(want) > 5000 and len(runs) > len({s for s, _ in want}) and set(want.values()) == {-1, 0, 1, 2, 3}


def test_classes_of_patterns_against_pieces(spark):
    """Miles at each stop are those of the smoothed classes of the pieces before its point."""
    shapes, index = (cut(df) for df in _cases(spark, np.random.default_rng(6)))
    x, y = project(F.col("lat"), F.col("lon"))
    stops = shapes.where("lat is not null and seq % 3 = 1").select(F.concat(F.lit("p"), "shape_id").alias("pattern_id"), F.when(F.col("shape_id") != "s2", F.col("shape_id")).alias("shape_id"), F.col("seq").alias("pos"), (x + F.when(F.col("shape_id") == "s4", 900.0).otherwise(3.0)).alias("x"), y.alias("y"))
    stops = cut(stops.unionByName(stops.where("shape_id = 's6'").withColumns({"pattern_id": F.lit("none"), "shape_id": F.lit("unknown")})))
    density = stops.select("pattern_id", "pos", F.array(F.col("pos") * 1.0, F.lit(0.5), F.lit(0.25)).alias("miles"))
    pieces = cut(roads.resample_shapes(shapes))
    classed = roads.smooth_classes(pieces.select("shape_id", "piece_no", "length").join(roads.match_to_roads(pieces, index), ["shape_id", "piece_no"]), ["shape_id"]).toPandas()
    points = pieces.select("shape_id", F.col("piece_no").alias("point_no"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    last = pieces.groupBy("shape_id").agg(F.max_by(F.struct("x1", "y1"), "piece_no").alias("p"), (F.max("piece_no") + 1).alias("point_no")).select("shape_id", "point_no", F.col("p.x1").alias("x"), F.col("p.y1").alias("y"))
    placed = roads.align_stops(stops.where("shape_id is not null"), points.unionByName(last)).where("median_offset <= 150").collect()
    want = {}
    for r in placed:
        before = classed[(classed.shape_id == r.pattern_id[1:]) & (classed.piece_no < r.point_no)]
        want[r.pattern_id, r.pos] = [before[before.cls == k].length.sum() / roads.MILE for k in range(4)]
    out = roads.classify_patterns(stops, shapes, index, density)
    found = {(r.pattern_id, r.pos): (r.miles, r.fallback) for r in out.collect()}
    assert out.dtypes == [("pattern_id", "string"), ("pos", "int"), ("miles", "array<double>"), ("fallback", "boolean")]
    assert len(found) == stops.count() and {k for k, v in found.items() if not v[1]} == set(want) and len({p for (p, _), v in found.items() if v[1]}) >= 4
    for (pattern, pos), (miles, fallback) in found.items():
        assert np.allclose(miles, [pos, 0.5, 0.25, 0.0] if fallback else want[pattern, pos], atol=1e-9), (pattern, pos)
    assert any(sum(m) > 1 for m in want.values())


def test_no_piece_of_a_shape_is_stored(spark):
    """Of 30 shapes of 60 km each, 90 000 pieces, lists of points are stored, not the pieces."""
    lat, lon = 40 + F.col("seq") * 0.18, -75 + F.col("shape_id") * 0.001 + F.col("seq") * 0.01
    shapes = spark.range(30).select(F.col("id").alias("shape_id"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("seq")).select("shape_id", "seq", lat.alias("lat"), lon.alias("lon"))
    x, y = project(F.col("lat"), F.col("lon"))
    stops = shapes.select(F.col("shape_id").alias("pattern_id"), "shape_id", F.col("seq").alias("pos"), x.alias("x"), y.alias("y"), F.array(*[F.lit(0.0)] * 3).alias("miles"))
    index = spark.createDataFrame([("w", "0-0", 0.0, 0.0, 40.0, 0.0, 1, 1, 0, "tagged", False)], INDEX)
    cut(spark.range(1))
    stored = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) for f in files)
    before = stored()
    assert roads.classify_patterns(stops.drop("miles"), shapes, index, stops.select("pattern_id", "pos", "miles")).count() == 120
    assert stored() - before < 90_000 * 4
