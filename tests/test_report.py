"""Feeds of routes: tables that grow are not sent to all tasks."""

from transit_spark.operators import report


def test_route_feeds_sends_no_growing_table_to_all_tasks(spark, tmp_path):
    legs = spark.createDataFrame([(1, "flex", 5), (1, "ride", None), (2, "flex", 6)], "route_id int, kind string, zone_id int")
    options = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (2, 12)], "route_id int, pattern_id int")
    patterns = spark.createDataFrame([(10, "a"), (11, "b")], "pattern_id int, feed_id string")
    zones = spark.createDataFrame([(5, "b"), (6, "layer")], "zone_id int, source string")
    manifest = spark.createDataFrame([("a", True, "2026-05-31T00:00"), ("b", False, "2027-01-01")], "feed_id string, stale boolean, service_end string")
    patterns.write.parquet(f"{tmp_path}/patterns")
    zones.write.parquet(f"{tmp_path}/zones")
    patterns, zones = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("patterns", "zones"))
    out = report.route_feeds(legs, options, patterns, zones, manifest)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    assert sorted(((r.route_id, r.feed_id, r.note) for r in out.collect()), key=str) == [(1, "a", "calendar ended 2026-05-31"), (1, "b", None), (2, "b", None)]
