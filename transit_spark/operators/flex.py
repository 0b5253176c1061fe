"""On-demand zones: membership, access points and equivalent rides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.checkpoint import cut
from transit_spark.config import PARATRANSIT, OnDemand, Period, Walking
from transit_spark.functions.cost import walk_seconds
from transit_spark.functions.geo import distance, nearest_on_segment, project
from transit_spark.functions.text import parse_gtfs_time, parse_hours
from transit_spark.operators.frequency import effective_frequency


def union_windows(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, headway: overlapping and touching windows of a key merged; the first one's headway stays."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("headway", F.struct("start", F.col("end"))).alias("headway")).drop("_island")


def open_zones(zones: DataFrame, pattern: str = PARATRANSIT) -> DataFrame:
    """Zones that anyone may use, by name and agency."""
    return zones.where(~F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("agency", F.lit(""))).rlike(pattern))


def zone_segments(zones: DataFrame) -> DataFrame:
    """zone_id, x0, y0, x1, y1: the sides of all rings (array of arrays of (lon, lat)), closed where they aren't."""
    rings = zones.select("zone_id", F.posexplode("rings").alias("ring", "points"))
    closed = rings.withColumn("points", F.concat("points", F.array(F.col("points")[0])))
    side = F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b")))
    rows = closed.select("zone_id", side.alias("s"))
    x0, y0 = project(F.col("s.a.lat"), F.col("s.a.lon"))
    x1, y1 = project(F.col("s.b.lat"), F.col("s.b.lon"))
    return rows.select("zone_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).where("x0 <> x1 or y0 <> y1")


def _near_box(nodes: DataFrame, segments: DataFrame, margin: float) -> DataFrame:
    """zone_id, node, x, y of nodes within ``margin`` of a zone's box, by a grid of 5 km that both are dealt to."""
    size = 5000.0
    x, y = project(F.col("lat"), F.col("lon"))
    plane = nodes.select("node", x.alias("x"), y.alias("y"))
    box = segments.groupBy("zone_id").agg(*[f(F.least(a, b) if f is F.min else F.greatest(a, b)).alias(n) for f, a, b, n in ((F.min, "x0", "x1", "west"), (F.min, "y0", "y1", "south"), (F.max, "x0", "x1", "east"), (F.max, "y0", "y1", "north"))])
    cells = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - margin) / size), F.floor((F.col(hi) + margin) / size)))
    dealt = box.withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north"))
    own = plane.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    return own.join(dealt, ["cx", "cy"]).where((F.col("x") >= F.col("west") - margin) & (F.col("x") <= F.col("east") + margin) & (F.col("y") >= F.col("south") - margin) & (F.col("y") <= F.col("north") + margin)).select("zone_id", "node", "x", "y")


#: Height of a row of the grid in which sides of zones meet nodes, in metres.
ROW = 500.0


def _by_row(sides: DataFrame, low: str, high: str, margin: float = 0.0) -> DataFrame:
    """``sides`` once for every row of the grid that [low - margin, high + margin] touches."""
    return sides.withColumn("row", F.explode(F.sequence(F.floor((F.col(low) - margin) / ROW), F.floor((F.col(high) + margin) / ROW))))


def zone_members(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """zone_id, node of nodes inside a zone: an odd number of sides of its rings crosses the ray to the east. A node meets only
    the sides that touch its row of the grid, however many a zone has."""
    segments = zone_segments(zones)
    sides = _by_row(segments.withColumns({"low": F.least("y0", "y1"), "high": F.greatest("y0", "y1")}).where("low < high"), "low", "high")
    near = _near_box(nodes, segments, 0.0).withColumn("row", F.floor(F.col("y") / ROW)).join(sides, ["zone_id", "row"])
    crosses = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (F.col("x") < (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    return near.groupBy("zone_id", "node").agg(F.sum(F.when(crosses, 1).otherwise(0)).alias("n")).where("n % 2 = 1").select("zone_id", "node")


def nearest_boundary(nodes: DataFrame, zones: DataFrame, radius: float = 2500.0) -> DataFrame:
    """zone_id, node, dist, qx, qy: the point of a zone's boundary nearest to each node outside it, within ``radius``. A node meets the sides
    in the cells of a grid of that side around its own."""
    segments = zone_segments(zones)
    outside = _near_box(nodes, segments, radius).join(zone_members(nodes, zones), ["zone_id", "node"], "left_anti")
    cell = lambda c: F.floor(c / radius)
    across = lambda a, b: F.explode(F.sequence(cell(F.least(a, b)) - 1, cell(F.greatest(a, b)) + 1))
    # Of a long side only the cells along it: its part within a column of cells spans few rows.
    sides = segments.withColumn("cx", across("x0", "x1"))
    slope = (F.col("y1") - F.col("y0")) / F.when(F.col("x1") != F.col("x0"), F.col("x1") - F.col("x0"))
    at = lambda x: F.greatest(F.least("y0", "y1"), F.least(F.greatest("y0", "y1"), F.col("y0") + (x - F.col("x0")) * slope))
    ends = [F.when(slope.isNull(), F.col(y)).otherwise(at((F.col("cx") + k) * radius)) for k, y in ((-1, "y0"), (2, "y1"))]  # least and greatest pass over nulls
    sides = sides.withColumn("cy", F.explode(F.sequence(cell(F.least(*ends)) - 1, cell(F.greatest(*ends)) + 1)))
    near = outside.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))}).join(sides, ["zone_id", "cx", "cy"])
    qx, qy = nearest_on_segment(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    near = near.withColumns({"qx": qx, "qy": qy}).withColumn("dist", distance(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")))
    best = near.where(F.col("dist") <= radius).groupBy("zone_id", "node").agg(F.min(F.struct("dist", "qx", "qy")).alias("q"))
    return best.select("zone_id", "node", "q.dist", "q.qx", "q.qy")


def flex_frequency(zones: DataFrame, day: str, demand: OnDemand = OnDemand(), period: Period = Period()) -> DataFrame:
    """zone_id, freq on a date: a departure every headway (the zone's own or the default) from each window's start to its end."""
    windows = zones.select("zone_id", F.explode(F.element_at("service", F.weekday(F.to_date(F.lit(day))))).alias("w")).select("zone_id", "w.start", "w.end", F.coalesce("w.headway", F.lit(demand.headway)).alias("headway"))
    trips = windows.where("end >= start and headway > 0").select("zone_id", F.explode(F.expr("sequence(start, end, headway)")).alias("dep"))
    return effective_frequency(trips, ["zone_id"], "dep", period.start, period.end)


def flex_edges(nodes: DataFrame, zones: DataFrame, day: str, demand: OnDemand = OnDemand(), walking: Walking = Walking(), period: Period = Period(), most_points: int = 700) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rides, walks, new nodes): rides between every two access points of an open zone that runs, which are the nodes inside
    and an edge point for each 250 m of boundary near outside nodes; walks between those nodes and the edge points. Of a
    zone with over ``most_points`` access points those nearest to their centroid are joined, as the job defines it. A zone
    that doesn't run on the day has no rides, walks or points."""
    running = cut(flex_frequency(zones, day, demand, period).where("freq > 0"))
    zones = cut(open_zones(zones).join(running.select("zone_id"), "zone_id", "left_semi"))
    x, y = project(F.col("lat"), F.col("lon"))
    plane = nodes.select("node", x.alias("x"), y.alias("y"))
    inside = zone_members(nodes, zones).join(plane, "node").select("zone_id", "node", "x", "y")
    edge = nearest_boundary(nodes, zones, walking.gap).withColumns({"ex": F.floor(F.col("qx") / 250), "ey": F.floor(F.col("qy") / 250)})
    point = edge.groupBy("zone_id", "ex", "ey").agg(F.min_by(F.struct("qx", "qy"), "node").alias("q"))
    point = point.select("zone_id", "ex", "ey", F.xxhash64(F.lit("zone edge"), "zone_id", "ex", "ey").alias("edge"), "q.qx", "q.qy")
    links = edge.select("zone_id", "node", "ex", "ey", "dist").join(point, ["zone_id", "ex", "ey"])
    walks = links.select(F.col("node").alias("u"), F.col("edge").alias("v"), "dist").unionByName(links.select(F.col("edge").alias("u"), F.col("node").alias("v"), "dist"))
    walks = walks.select("u", "v", walk_seconds(F.col("dist"), walking).alias("time"), "dist")
    access = inside.unionByName(point.select("zone_id", F.col("edge").alias("node"), F.col("qx").alias("x"), F.col("qy").alias("y")))
    whole = W.partitionBy("zone_id")
    access = access.withColumn("_d", distance(F.col("x"), F.col("y"), F.avg("x").over(whole), F.avg("y").over(whole)))
    access = access.withColumn("_n", F.row_number().over(whole.orderBy("_d", "node"))).where(F.col("_n") <= most_points).drop("_d", "_n")
    a, b = (access.select("zone_id", F.col("node").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for n in ("u", "v"))
    rides = a.join(running, "zone_id").join(b, "zone_id").where("u <> v").withColumn("dist", distance(F.col("xu"), F.col("yu"), F.col("xv"), F.col("yv")))
    rides = rides.select("u", "v", "freq", F.greatest(F.col("dist") * demand.detour / demand.pace, F.lit(60.0)).alias("time"), "dist", "zone_id")
    return rides, walks, point.select(F.col("edge").alias("node"), F.col("qx").alias("x"), F.col("qy").alias("y"), "zone_id")


def zones_from_layer(features: DataFrame, keep_types: list[str], type_field: str = "type") -> DataFrame:
    """zone_id, name, agency, rings, service, source, info_url of a map layer's features (type, name, agency, rings, weekday,
    saturday, sunday hours, ...) of the wanted types."""
    kept = features.where(F.col(type_field).isin(*keep_types))
    days = F.map_from_entries(F.array(*[F.struct(F.lit(d), parse_hours(F.col("weekday" if d < 5 else ("saturday", "sunday")[d - 5]))) for d in range(7)]))
    return kept.select("zone_id", "name", "agency", "rings", days.alias("service"), "source", "info_url")


def gtfs_flex_zones(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, locations: DataFrame, date: str) -> DataFrame:
    """S4 columns of the zones in which trips of the date pick up: stop_times (with a row_no) at a location, its polygon, and the united windows, those that end before
    they begin too. A zone has the names of the route (route_short_name, else route_long_name, else the location's id; agency) of its first row, and its feed as source."""
    rows = stop_times.where(F.coalesce("location_id", F.lit("")) != "").select("feed_id", "row_no", F.trim("trip_id").alias("trip_id"), F.trim("location_id").alias("location_id"), parse_gtfs_time(F.col("start_pickup_drop_off_window")).alias("start"), parse_gtfs_time(F.col("end_pickup_drop_off_window")).alias("end"))
    rows = rows.where("start is not null and end is not null").join(trips.select("feed_id", "trip_id", "route_id"), ["feed_id", "trip_id"]).join(routes.select("feed_id", "route_id", "route_short_name", "route_long_name", "agency"), ["feed_id", "route_id"])
    windows = union_windows(rows.select("feed_id", "location_id", "start", "end", F.lit(None).cast("int").alias("headway")), ["feed_id", "location_id"])
    listed = windows.groupBy("feed_id", "location_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "headway"))).alias("windows"))
    given = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    name = F.trim(F.coalesce(given("route_short_name"), given("route_long_name"), F.col("location_id")))
    named = rows.groupBy("feed_id", "location_id").agg(F.min_by(F.struct(name.alias("name"), "agency"), "row_no").alias("r"))
    service = F.map_from_entries(F.array(F.struct(F.weekday(F.to_date(F.lit(date))), F.col("windows"))))
    feed = F.col("feed_id").cast("string")
    return locations.join(listed, ["feed_id", "location_id"]).join(named, ["feed_id", "location_id"]).select(F.concat_ws("-", feed, "location_id").alias("zone_id"), "r.name", "r.agency", "rings", service.alias("service"), feed.alias("source"), F.lit(None).cast("string").alias("info_url"))
