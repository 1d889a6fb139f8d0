"""Comparing entities of pairs extracts those of a text once, not for each side."""

from pyspark.sql import functions as F

from docloom.operators import entities


def test_entities_are_extracted_once(spark):
    looked = spark.sparkContext.accumulator(0)

    def noted(x):
        looked.add(1)
        return x

    found = spark.createDataFrame([(1, "Peru"), (1, "peru"), (1, "2031"), (2, "PERU"), (3, "2031")], "doc_id long, text string")
    found = found.withColumn("text", F.udf(noted, "string")("text"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 9)], "id_a long, id_b long")
    got = sorted((r.id_a, r.id_b, r.overlap) for r in entities.entity_overlap(pairs, found).collect())
    assert got == [(1, 2, ["peru"]), (1, 3, ["2031"]), (1, 9, []), (2, 3, [])]
    assert looked.value == 5
