"""Sums of similarities are those of the similarities, and no row is made for a query and a history row."""

from pyspark.sql import functions as F

from docloom.operators import recommend
from docloom.plans.queries import QUERIES


def test_equal_sums_of_similarities(spark):
    kind = "c string, d int, x double, y double"
    hist = spark.createDataFrame([("a", 1, 1.0, 5.0), ("b", 2, 4.0, 1.0), (None, 1, 2.5, 0.0), ("a", None, None, 3.0), ("c", 3, -7.0, 2.0), ("e", 9, None, None)], "c string, d int, x double, y double").withColumn("id", F.monotonically_increasing_id())
    asked = spark.createDataFrame([(1, "a", 1, 2.0, 2.0), (2, "zz", 77, None, None), (3, None, 2, 100.0, None), (4, "e", 9, 0.0, 1.0), (4, "b", 1, 1.0, 1.0), (None, "c", 3, -3.0, 2.0)], f"query_id long, {kind}")
    for cats, nums in ((["c", "d"], ["x", "y"]), ([], ["x"])):
        scored = recommend.similarity(asked, hist, cats, nums, "id")
        want = sorted(map(str, ((r[0], r[1], round(r[2], 9) + 0.0) for r in scored.groupBy("query_id").agg(F.count(F.lit(1)), F.sum("similarity")).collect())))
        got = sorted(map(str, ((r[0], r[1], round(r[2], 9) + 0.0) for r in recommend.similarity_totals(asked, hist, cats, nums).collect())))
        assert got == want
        assert recommend.similarity_totals(asked, hist.limit(0), cats, nums).count() == 0


def test_no_row_a_pair(spark, sf):
    plan = QUERIES["r3_similarity"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "cats" not in plan
