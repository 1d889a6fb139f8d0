"""Shards hold every row once, are near equal in bytes, and keep equal texts side by side."""

import zlib
from collections import Counter, defaultdict

import pytest

from docloom.llm import shards as S


def made(spark, df, n, tmp_path, name="x", **settings):
    path = f"file://{tmp_path}/{name}"
    S.write_shards(df, n, path, **settings)
    return S.read_shards(spark, path, df).collect()


def whole(df, rows, n):
    """Every row is there once, its size and checksum are right, slots have no gaps."""
    assert Counter(map(repr, (r.doc for r in rows))) == Counter(map(repr, df.collect()))
    slots = defaultdict(list)
    for r in rows:
        text = (r.doc.text or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def sizes(rows, n):
    found = Counter()
    for r in rows:
        found[r.shard] += r.size
    return [found[i] for i in range(n)]


def test_documents(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = made(spark, df, 10, tmp_path)
    whole(df, rows, 10)
    mean, largest = sum(r.size for r in rows) / 10, max(r.size for r in rows)
    assert all(abs(s - mean) <= 0.02 * mean + largest for s in sizes(rows, 10))


def test_query(spark, sf):
    found = S.op13_sharding(spark, sf)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and max(r.shard for r in rows) < 40


def test_awkward(spark, awkward, tmp_path):
    df = awkward.withColumn("shard", awkward.text).withColumn("slot", awkward.doc_id).withColumn("a b.c", awkward.lang)
    whole(df, made(spark, df, 5, tmp_path), 5)


def test_nothing(spark, nothing, tmp_path):
    assert made(spark, nothing, 5, tmp_path) == []


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: 7, lambda i: None, lambda i: f"k{i}"], ids=["own", "one", "null", "text"])
def test_group_of_a_third_is_split(spark, tmp_path, ids):
    rows = [(ids(i), "copy of one text " * 5) for i in range(1000)] + [(ids(i), f"text {i} " * 10) for i in range(2000)]
    kind = "string" if isinstance(ids(0), str) else "long"
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    found = made(spark, df, 20, tmp_path)
    whole(df, found, 20)
    by = sizes(found, 20)
    mean = sum(by) / 20
    assert max(by) <= 1.03 * mean + 200 and min(by) >= 0.97 * mean - 200


def test_equal_texts_stay_together(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 4000}") for i in range(8000)], "doc_id long, text string").repartition(3)
    found = made(spark, df, 8, tmp_path)
    where = defaultdict(set)
    for r in found:
        where[r.doc.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    again = made(spark, df.repartition(5), 8, tmp_path, "again")
    assert {(r.doc.doc_id, r.shard, r.slot) for r in again} == {(r.doc.doc_id, r.shard, r.slot) for r in found}


def test_pieces(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(3000)], "doc_id long, text string").repartition(3)
    whole(df, made(spark, df, 3, tmp_path, piece_bytes=20_000), 3)


def test_one_row_and_one_shard(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 100_000)], "doc_id long, text string")
    whole(df, made(spark, df, 4, tmp_path, "a"), 4)
    whole(df, made(spark, df, 1, tmp_path, "b"), 1)
