"""The Merkle manifest against a plain tree, on awkward tables, and with altered rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """(root, [[(before, after) of each level] of each digest])."""
    proofs, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        made, held = [], []
        for k in range(0, len(digests), 16):
            run = digests[k : k + 16]
            for j in range(len(run)):
                for i in under[k + j]:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            made.append(sha("".join(run)))
            held.append([i for u in under[k : k + 16] for i in u])
        digests, under = made, held
    return digests[0], proofs


def plain(rows):
    """The result of op11 by the contract's words, for rows of (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        other = leaf((*r[:4], r[4].translate(CAPITALS))) if changed else leaf(r)
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), other, r[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    inside = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, over = tree([inside[s][0] for s in sources])
    out = []
    for s, top in zip(sources, over, strict=True):
        for x, own in zip(sorted(by[s], key=lambda x: x[:3]), inside[s][1], strict=True):
            made = x[3]
            for before, after in own + top:
                made = sha(before + made + after)
            out.append((x[4], x[2], inside[s][0], root, sha("".join(b + a for b, a in own + top)), made, made == root))
    return out


def found(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()]


def key(r):
    return tuple(str(x) for x in r)


def check(spark, df, tmp_path):
    want = plain([tuple(r) for r in df.select(*COLUMNS).collect()])
    assert sorted(found(spark, df, tmp_path), key=key) == sorted(want, key=key)


def test_documents(spark, sf, tmp_path):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"), tmp_path)


def test_awkward(spark, awkward, tmp_path):
    check(spark, awkward.withColumn("n_chars", F.length("text").cast("long")), tmp_path)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [256, 1], [257, 1, 1], [1] * 17, [5] * 40], ids=str)
def test_shapes(spark, tmp_path, sizes):
    rng = random.Random(3)
    rows = [(i * 7 % 1000, f"s{s}" if s else None, "en", i, rng.choice(["Text", "TEXT", None, ""])) for s, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    check(spark, spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3), tmp_path)


def test_one_hot_source_of_equal_rows(spark, tmp_path):
    rows = [(1, "hot", "en", 4, "Same")] * 300 + [(i, f"s{i}", "en", 1, "x") for i in range(5)]
    check(spark, spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3), tmp_path)


def test_nothing(spark, nothing):
    empty = nothing.withColumn("n_chars", F.lit(0))
    assert merkle.manifest(empty).columns == ["id", "source", "leaf", "altered", "subroot", "root", "steps"]
    assert merkle.manifest(empty).count() == 0


def test_verify(spark, awkward):
    df = awkward.withColumn("n_chars", F.length("text").cast("long"))
    made = merkle.manifest(df)
    assert merkle.verify(df, made).filter("not verified").count() == 0
    altered = df.withColumn("text", F.when(F.col("doc_id") == 1, "other").otherwise(F.col("text")))
    assert [r.id for r in merkle.verify(altered, made).filter("not verified").collect()] == [1]
    assert merkle.verify(df.withColumn("doc_id", F.lit(99)), made).filter("verified").count() == 0


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(merkle.OP11_SQL).fetchall()
    assert sorted(tuple(r) for r in merkle.op11_merkle_manifest(spark, sf).collect()) == sorted(want)
