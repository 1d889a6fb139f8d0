"""Rule tables of any size give what looking for each keyword gives, in one walk a sentence."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import automaton, classify


def plain(sentence, rules):
    return {c for c, k in rules if c is not None and k is not None and k in sentence.lower()}


@pytest.mark.parametrize("block", [automaton.BLOCK, 9])
def test_as_each_keyword(spark, block):
    rng = random.Random(4)
    rules = [(rng.choice("abcde"), "".join(rng.choice("xyz ") for _ in range(rng.randrange(1, 5))).strip() or "z") for _ in range(60)]
    rules += [("e", "straße"), ("f", None), (None, "x"), ("g", "naïve é"), ("a", "xx"), ("b", "xx")]
    texts = [(i, ". ".join("".join(rng.choice("XYz ") for _ in range(20)) for _ in range(3))) for i in range(40)] + [(50, None), (51, ""), (52, "In der STRAßE. Naïve É here."), (0, "Xx yz")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = classify.classify_by_rules(df, spark.createDataFrame(rules, "category string, keyword string"), block=block).collect()
    from docloom.operators.explode import split_sentences

    want = sorted((r.doc_id, c, r.pos, r.sentence) for r in split_sentences(df).collect() for c in plain(r.sentence, rules))
    assert sorted(map(tuple, found)) == want and len(want) > 100


def test_empty_keyword_and_no_rules(spark):
    df = spark.createDataFrame([(1, "One here. Two there.")], "doc_id long, text string")
    none = spark.createDataFrame([], "category string, keyword string")
    assert classify.classify_by_rules(df, none).count() == 0
    assert classify.classify_by_rules(df, spark.createDataFrame([("all", "")], "category string, keyword string")).count() == 2


def test_time_does_not_grow_with_keywords(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words that go on and on "), 20), F.col("id").cast("string"), F.lit(" keyword77x. And more text.")).alias("text")).repartition(4)
    took = []
    for n in (500, 100_000):
        rules = spark.range(n).select(F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("category"), F.concat(F.lit("keyword"), F.col("id").cast("string"), F.lit("x")).alias("keyword"))
        best = []
        for _ in range(2):
            began = time.time()
            assert classify.classify_by_rules(df, rules).count() == 3000
            best.append(time.time() - began)
        took.append(min(best))
    assert took[1] < 3 * took[0] + 6  # building the automaton once a worker included


def test_all_places_of_nested_keywords_take_linear_time():
    made = automaton.Automaton([("a", "a" * n) for n in range(1, 60)] + [("b", "zzz")])
    times = []
    for n in (200_000, 400_000):
        began = time.process_time()
        assert made.categories("a" * n) == {"a"}
        times.append(time.process_time() - began)
    assert times[1] < 2.5 * times[0] + 0.1
