"""Tables that searches share: written once, and not moved again by joins."""

from pyspark.sql import functions as F

from transit_spark.checkpoint import cut, sorted_by
from transit_spark.operators import search


def test_joins_move_only_the_side_that_is_not_sorted(spark):
    rides = sorted_by(spark.range(2000).selectExpr("id % 50 AS node", "id AS v"), "node")
    front = cut(spark.range(300).selectExpr("id % 70 AS node", "id AS label"))
    both = front.join(rides.where("v % 2 = 0").hint("merge"), "node")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert both.count() == sum(1 for i in range(300) for v in range(0, 2000, 2) if i % 70 == v % 50)


def test_probes_of_a_walking_limit_share_the_rides(spark, monkeypatch):
    """Two islands of rides, joined by walks of several lengths: many probes, one table of rides."""
    made, write = [], search.sorted_by
    monkeypatch.setattr(search, "sorted_by", lambda df, key: made.append(key) or write(df, key))
    rides = spark.createDataFrame([(1, 2, 4.0), (2, 3, 4.0), (11, 12, 4.0), (12, 13, 4.0)], "u long, v long, freq double")
    walks = spark.createDataFrame([(3, 11, 900.0 + 100 * k) for k in (6, 3, 5)] + [(1, 12, 2000.0), (2, 21, 1000.0)], "u long, v long, dist double").withColumn("time", F.col("dist"))
    asked = spark.createDataFrame([("a", 1, 13), ("b", 1, 3), ("c", 1, 99)], "query_id string, origin long, destination long")
    found = {r.query_id: r.max_walk for r in search.required_walk(search.Network(rides, walks), asked).collect()}
    assert found == {"a": 1200.0, "b": 800.0} and made == ["node"]
