"""How local a ride is by the density of its stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.functions.geo import MILE, distance, project


def stop_density_class(hops: DataFrame, keys: list[str], window_mi: float = 1.0) -> DataFrame:
    """``hops`` (keys, pos, miles) and cls: stops a mile among the hops whose middles are within half of ``window_mi``; 0 from four, 1 from two, else 2.
    For the density, not in the miles, a hop is a thousandth of a mile at least."""
    by = ", ".join(keys)
    rows = hops.withColumn("_hop", F.greatest(F.col("miles"), F.lit(0.001)))
    rows = rows.withColumn("_mid", F.sum("_hop").over(W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) - F.col("_hop") / 2)
    frame = f"over (partition by {by} order by _mid range between {window_mi / 2}D preceding and {window_mi / 2}D following)"
    rows = rows.withColumn("_density", F.expr(f"count(*) {frame} / sum(_hop) {frame}"))
    return rows.withColumn("cls", F.when(F.col("_density") >= 4, 0).when(F.col("_density") >= 2, 1).otherwise(2)).drop("_hop", "_mid", "_density")


def stop_density_miles(pattern_stops: DataFrame, nodes: DataFrame, window_mi: float = 1.0) -> DataFrame:
    """pattern_id, pos, miles ([local, city, express], cumulative): hops between served stops by their class; positions
    where nobody boards or alights repeat the value before them."""
    x, y = project(F.col("lat"), F.col("lon"))
    placed = pattern_stops.join(nodes.select("node", x.alias("x"), y.alias("y")), "node")
    order = W.partitionBy("pattern_id").orderBy("pos")
    served = placed.where("board or alight").withColumns({"_x": F.lag("x").over(order), "_y": F.lag("y").over(order)})
    hops = served.where("_x is not null").select("pattern_id", "pos", (distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")) / MILE).alias("miles"))
    classed = stop_density_class(hops, ["pattern_id"], window_mi).select("pattern_id", "pos", F.col("miles").alias("hop"), "cls")
    rows = placed.select("pattern_id", "pos").join(classed, ["pattern_id", "pos"], "left")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    return rows.select("pattern_id", "pos", F.array(*[F.sum(F.when(F.col("cls") == k, F.col("hop")).otherwise(0.0)).over(running) for k in range(3)]).alias("miles"))
