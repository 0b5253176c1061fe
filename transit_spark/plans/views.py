"""Timetable-like views of the given tables, by integer arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.checkpoint import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed_id, stop_id, name, lat, lon: customers, in nations as feeds."""
    c = table(spark, sf_dir, "customer")
    lat, lon = 40 + (F.col("c_custkey") * 7919 % 5000) / 10000, -75 + (F.col("c_custkey") * 104729 % 5000) / 10000
    return c.select(F.col("c_nationkey").alias("feed_id"), F.col("c_custkey").alias("stop_id"), F.col("c_name").alias("name"), lat.alias("lat"), lon.alias("lon"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops(spark, sf_dir).withColumnRenamed("stop_id", "node")


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, pos, route, stop, t: line items of an order as stops of a trip; inner ones that were not returned are blank."""
    li = table(spark, sf_dir, "lineitem")
    own = W.partitionBy("l_orderkey")
    rows = li.select("l_orderkey", "l_returnflag", F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("pos"), F.count("*").over(own).alias("len"))
    n = table(spark, sf_dir, "supplier").count()  # routes and stops grow with the data
    route = F.col("l_orderkey") % (2 * n)
    blank = (F.col("l_returnflag") == "N") & (F.col("pos") > 1) & (F.col("pos") < F.col("len"))
    t = ((F.col("l_orderkey") * 37 % 1440) * 60 + 300 * F.col("pos")).cast("int")
    return rows.select(F.col("l_orderkey").alias("trip"), "pos", route.alias("route"), ((route * 13 + F.col("pos") * 7) % (n + 50)).alias("stop"), F.when(~blank, t).alias("t"))


def departures(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """key, dep: events by a column, at their second of the day."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col(key).alias("key"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))).cast("int").alias("dep"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed_id, service_id, start, end, days: suppliers; a service runs on the weekdays whose bit its key has."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    days = F.array(*[F.expr(f"(s_suppkey div {2**i}) % 2 = 1") for i in range(7)])
    start = F.date_add(F.lit("1995-01-01").cast("date"), (key % 300).cast("int"))
    return s.select(F.col("s_nationkey").alias("feed_id"), key.alias("service_id"), start.alias("start"), F.date_add(start, (key % 400 + 100).cast("int")).alias("end"), days.alias("days"))


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed_id, service_id, date, kind: orders, as dates on which a supplier's service is added or removed."""
    s = table(spark, sf_dir, "supplier")
    o = table(spark, sf_dir, "orders")
    n = s.count()
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(2)
    rows = o.select((F.col("o_custkey") % n + 1).alias("service_id"), F.col("o_orderdate").cast("date").alias("date"), kind.alias("kind")).distinct()
    return rows.join(s.select(F.col("s_suppkey").alias("service_id"), F.col("s_nationkey").alias("feed_id")), "service_id")


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, freq, time, miles: line items as rides between suppliers."""
    n = table(spark, sf_dir, "supplier").count()
    li = table(spark, sf_dir, "lineitem")
    miles = F.array(*[F.when(F.col("l_linenumber") % 3 == k, F.col("l_partkey") % 10 / 4).otherwise(0.0) for k in range(3)])
    return li.select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") % n + 1).alias("v"), F.col("l_quantity").cast("double").alias("freq"), (60 + F.col("l_partkey") % 600).cast("double").alias("time"), miles.alias("miles")).where("u <> v")


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, time, dist: from each supplier to the next one."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    dist = (F.col("s_suppkey") * 37 % 900 + 50).cast("double")
    return s.select(F.col("s_suppkey").alias("u"), (F.col("s_suppkey") % n + 1).alias("v"), (dist * 1.3 / 1.25).alias("time"), dist.alias("dist"))


def shape_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shape_id, seq, lat, lon: the line items of an order as points within 600 m."""
    li = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("shape_id"), seq.alias("seq"), (40.6 + (F.col("l_partkey") * 7919 % 50) / 10000).alias("lat"), (-75 + (F.col("l_suppkey") * 104729 % 50) / 10000).alias("lon"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, tags, nodes: parts as streets of two sides."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*[F.lit(x) for x in ("motorway", "trunk", "primary", "secondary", "residential", "footway")])
    lanes = F.when(size % 3 != 0, (size % 5 + 1).cast("string"))
    tags = F.create_map(F.lit("highway"), F.element_at(kinds, (size % 6 + 1).cast("int")), F.lit("name"), F.col("p_brand"), F.lit("lanes"), lanes, F.lit("oneway"), F.when(key % 4 == 0, "yes").otherwise("no"), F.lit("bridge"), F.when(key % 7 == 0, "yes").otherwise("no"))
    lat, lon = 40.6 + (key * 7919 % 500) / 10000, -75 + (key * 104729 % 500) / 10000
    point = lambda i: F.struct((lat + i * 0.001).alias("lat"), (lon + (i % 2) * 0.001).alias("lon"))
    return p.select(key.alias("way_id"), tags.alias("tags"), F.array(*[point(i) for i in range(3)]).alias("nodes"))
