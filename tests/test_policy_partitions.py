"""Policy texts are made in as many tasks as their number asks for, however few bytes of one file the customers take."""

from pyspark.sql import functions as F

from docloom.operators import entities
from docloom.plans.policy_docs import LARGE, policy_docs


def test_texts_of_one_small_file_are_dealt(spark, sf, tmp_path):
    spark.range(40_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    made = policy_docs(spark, str(tmp_path))
    counts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 40_000 and len(counts) == 8 and max(counts) < 1.2 * LARGE
    # What is grouped by document isn't sent again.
    plan = entities.key_phrases(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_few_texts_still_use_the_cores(spark, sf, tmp_path):
    made = policy_docs(spark, "/root/testdata/sf0.01")
    assert made.rdd.getNumPartitions() == 3
