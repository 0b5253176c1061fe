"""Lanes and classes of road ways as Columns over a map of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(tags: Column, name: str) -> Column:
    """The first number of a tag, which may be a fraction; null for anything else."""
    first = F.trim(F.split(tags[name], ";")[0])
    return F.when(first.rlike(r"^\d+(\.\d*)?$"), first.cast("double"))


def direction(tags: Column) -> Column:
    """1 one way, -1 one way backwards, 0 both; roundabouts are one way, and motorways unless they say no."""
    stated, highway = F.coalesce(tags["oneway"], F.lit("")), F.coalesce(tags["highway"], F.lit(""))
    implied = F.coalesce(tags["junction"], F.lit("")).isin("roundabout", "circular") | (highway.isin("motorway", "motorway_link") & (stated != "no"))
    return F.when(stated.isin("yes", "1", "true") | implied, 1).when(stated == "-1", -1).otherwise(0)


def lanes_by_direction(tags: Column) -> tuple[Column, Column, Column]:
    """(oneway, lanes forward, lanes backward), null where no tag tells. A one-way street has all its lanes in its
    direction, and one against it unless tagged; of two directions of which one is tagged the other has as many."""
    way = direction(tags)
    total, forward, backward = (_count(tags, x) for x in ("lanes", "lanes:forward", "lanes:backward"))
    half = F.when(total.isNotNull(), F.greatest(F.floor(total / 2).cast("double"), F.lit(1.0)))
    with_, against = lambda x: F.coalesce(total, x), lambda x: F.coalesce(x, F.lit(1.0))
    fwd = F.when(way == 1, with_(forward)).when(way == -1, against(forward)).otherwise(F.coalesce(forward, backward, half))
    bwd = F.when(way == 1, against(backward)).when(way == -1, with_(backward)).otherwise(F.coalesce(backward, forward, half))
    return way, fwd, bwd


def is_controlled(tags: Column) -> Column:
    return F.coalesce(tags["highway"].isin("motorway", "motorway_link"), F.lit(False)) | (F.coalesce(tags["motorroad"], F.lit("")) == "yes")


def off_grade(tags: Column) -> Column:
    set_ = lambda x: F.coalesce(tags[x], F.lit("no")) != "no"
    return set_("tunnel") | set_("bridge") | (F.coalesce(F.trim(tags["layer"]), F.lit("0")) != "0")


def lane_class(lanes: Column, controlled: Column) -> Column:
    """0 one lane, 1 two, 2 three or more, 3 controlled access; null lanes are null."""
    return F.when(controlled, 3).when(lanes < 1.5, 0).when(lanes < 2.5, 1).when(lanes.isNotNull(), 2)


def base_highway(tags: Column) -> Column:
    return F.regexp_replace(tags["highway"], "_link$", "")
