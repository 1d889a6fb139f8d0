"""Operators in several threads of one session give right rows and leave nothing but results behind."""

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from docloom.llm import chat, mixing, quality
from docloom.operators import compare
from docloom.scratch import materialize, scratch
from docloom.session import shared_dir


def tables(spark):
    top = f"{shared_dir(spark).removeprefix('file://')}/docloom"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def chats(spark, salt):
    rows = [(c, t, "user", f"> message {c} {t - 1} says this {salt}\n\nmessage {c} {t} says this {salt}" if t else f"message {c} 0 says this {salt}") for c in range(20) for t in range(4)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_three_threads(spark):
    docs = spark.createDataFrame([(i, f"one two three {i} " * 5, f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    runs = {
        "chats": lambda: chat.format_chats(chats(spark, "a")),
        "other": lambda: chat.format_chats(chats(spark, "b")),
        "mix": lambda: mixing.mix(docs),
    }
    want = {name: sorted(map(str, run().collect())) for name, run in runs.items()}
    before = tables(spark)
    for _ in range(2):
        with ThreadPoolExecutor(3) as pool:
            got = {name: f.result() for name, f in {name: pool.submit(run) for name, run in runs.items()}.items()}
        assert {name: sorted(map(str, df.collect())) for name, df in got.items()} == want
    kinds = sorted(x[:-33] for x in tables(spark) - before)
    assert kinds == ["chats"] * 4 + ["mixed"] * 2


def test_what_is_left(spark):
    docs = spark.createDataFrame([(i, f"one two three {i} " * 20, f"s{i % 3}") for i in range(50)], "doc_id long, text string, source string")
    before = tables(spark)
    assert quality.judge(docs).count() == 50
    pairs = compare.neighbour_pairs(docs, ["source"])
    compare.text_similarity(docs, pairs).count()
    compare.compare_documents(docs, pairs).count()
    kinds = sorted(x[:-33] for x in tables(spark) - before)
    assert kinds == ["compared", "judged", "neighbour-pairs", "similarities"]


def test_scopes(spark):
    before = tables(spark)
    with scratch(spark):
        with scratch(spark):
            inner = materialize(spark.range(3), "inner")
            kept = materialize(inner.withColumn("x", F.lit(1)), "kept", keep=True)
        assert kept.count() == 3 and len(tables(spark) - before) == 1
    assert tables(spark) == before
