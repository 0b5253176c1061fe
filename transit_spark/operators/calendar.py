"""Which services run on which date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.functions.text import parse_gtfs_date

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def weekly_services(calendar: DataFrame) -> DataFrame:
    """feed_id, service_id, start, end, days (array of seven booleans) of ``calendar``; rows with a bad date are dropped."""
    days = F.array(*[F.trim(F.coalesce(F.col(d), F.lit(""))) == "1" for d in DAYS])
    return calendar.select("feed_id", "service_id", parse_gtfs_date(F.col("start_date")).alias("start"), parse_gtfs_date(F.col("end_date")).alias("end"), days.alias("days")).where("start is not null and end is not null")


def exception_dates(calendar_dates: DataFrame) -> DataFrame:
    """feed_id, service_id, date, kind (1 added, 2 removed)."""
    kind = F.expr("try_cast(trim(exception_type) as int)")
    return calendar_dates.select("feed_id", "service_id", parse_gtfs_date(F.col("date")).alias("date"), kind.alias("kind")).where("date is not null and kind in (1, 2)")


def services_on(weekly: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """feed_id, date, service_id running on each of ``dates`` (feed_id, date): the weekly ones and those added, less those removed."""
    regular = dates.join(weekly, "feed_id").where(F.col("date").between(F.col("start"), F.col("end")) & F.get("days", F.weekday("date"))).select("feed_id", "date", "service_id")
    asked = exceptions.join(dates.distinct(), ["feed_id", "date"])
    added = asked.where("kind = 1").select("feed_id", "date", "service_id")
    removed = asked.where("kind = 2").select("feed_id", "date", "service_id")
    return regular.unionByName(added).distinct().join(removed, ["feed_id", "date", "service_id"], "left_anti")


def calendar_range(weekly: DataFrame, exceptions: DataFrame) -> DataFrame:
    """feed_id, lo, hi over weekly rows and added dates."""
    spans = weekly.select("feed_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    added = exceptions.where("kind = 1").select("feed_id", F.col("date").alias("lo"), F.col("date").alias("hi"))
    return spans.unionByName(added).groupBy("feed_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def choose_service_date(weekly: DataFrame, exceptions: DataFrame, trips: DataFrame, target: str) -> DataFrame:
    """feed_id, service_date, note: the same weekday nearest to ``target`` on which at least 0.8 of the best day's trips run.

    Candidates are the eight nearest weeks within the calendar around the week that is nearest to the target, in order
    of their distance, earlier ones first. Feeds without a calendar, such a weekday or any trip have no row.
    """
    day = F.to_date(F.lit(target))
    spans = calendar_range(weekly, exceptions)
    first, last = F.ceil(F.datediff("lo", day) / 7).cast("int"), F.floor(F.datediff("hi", day) / 7).cast("int")
    weeks = spans.select("feed_id", first.alias("first"), last.alias("last")).where("first <= last").withColumn("mid", F.greatest("first", F.least("last", F.lit(0))))
    weeks = weeks.withColumn("k", F.explode(F.sequence(F.greatest("first", F.col("mid") - 8), F.least("last", F.col("mid") + 8))))
    near = F.row_number().over(W.partitionBy("feed_id").orderBy(F.abs("k"), "k"))
    weeks = weeks.withColumn("place", near).where("place <= 8").select("feed_id", "place", F.date_add(day, F.col("k") * 7).alias("date"))
    size = trips.groupBy("feed_id", "service_id").agg(F.count("*").alias("n"))
    running = services_on(weekly, exceptions, weeks.select("feed_id", "date")).join(size, ["feed_id", "service_id"]).groupBy("feed_id", "date").agg(F.sum("n").alias("n"))
    ranked = weeks.join(running, ["feed_id", "date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.withColumn("most", F.max("n").over(W.partitionBy("feed_id"))).where("most > 0 and n >= 0.8 * most")
    best = ranked.groupBy("feed_id").agg(F.min_by("date", "place").alias("service_date"))
    return best.withColumn("note", F.when(F.col("service_date") != day, F.format_string("timetable of %s used for %s", F.col("service_date").cast("string"), F.lit(target))))
