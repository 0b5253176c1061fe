"""Planar and great-circle geometry as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres of the earth's radius, degrees of the latitude at which the plane is true, metres a mile.
RADIUS, LATITUDE, MILE = 6_371_000.0, 40.6, 1609.344
_X = RADIUS * math.cos(math.radians(LATITUDE))


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Equirectangular metres (x, y)."""
    return F.radians(lon) * _X, F.radians(lat) * RADIUS


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees (lat, lon) of planar metres."""
    return F.degrees(y / RADIUS), F.degrees(x / _X)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def nearest_on_segment(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """The segment's point nearest to (x, y); a segment without length is a point."""
    dx, dy = x1 - x0, y1 - y0
    length = dx * dx + dy * dy
    share = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / length))).otherwise(0.0)
    return x0 + share * dx, y0 + share * dy


def _plane(spine: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return [(math.radians(lon) * _X, math.radians(lat) * RADIUS) for lat, lon in spine]


def distance_to_polyline_m(lat: Column, lon: Column, spine: list[tuple[float, float]]) -> Column:
    """Least planar distance to the segments between the (lat, lon) points of ``spine``."""
    x, y = project(lat, lon)
    points = _plane(spine)
    found = []
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        qx, qy = nearest_on_segment(x, y, *(F.lit(v) for v in (x0, y0, x1, y1)))
        found.append(distance(x, y, qx, qy))
    return F.least(*found) if len(found) > 1 else found[0]


def bbox_near_polyline(south: Column, west: Column, north: Column, east: Column, spine: list[tuple[float, float]], buffer_m: float) -> Column:
    """Whether any of 5 x 5 points of the box is within ``buffer_m`` of the spine, or any of 20 points of a segment is inside the box."""
    near = [
        distance_to_polyline_m(south + (north - south) * (i / 4), west + (east - west) * (j / 4), spine) <= buffer_m
        for i in range(5) for j in range(5)
    ]
    steps = [(a[0] + (b[0] - a[0]) * k / 19, a[1] + (b[1] - a[1]) * k / 19) for a, b in zip(spine, spine[1:], strict=False) for k in range(20)]
    samples = F.array(*[F.struct(F.lit(p).alias("lat"), F.lit(q).alias("lon")) for p, q in steps])
    inside = F.exists(samples, lambda s: s["lat"].between(south, north) & s["lon"].between(west, east))
    out = inside
    for c in near:
        out = out | c
    return out


def grid_cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def around(df: DataFrame, x: str, y: str, size: float, cx: str = "cx", cy: str = "cy") -> DataFrame:
    """``df`` nine times, with the cells (cx, cy) of and around each point: joined with points' own cells, all pairs within ``size`` meet once."""
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    out = df.withColumns({"_dx": F.explode(steps)}).withColumn("_dy", F.explode(steps))
    return out.withColumns({cx: grid_cell(F.col(x), size) + F.col("_dx"), cy: grid_cell(F.col(y), size) + F.col("_dy")}).drop("_dx", "_dy")
