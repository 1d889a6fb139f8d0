"""The divergence audit against plain counting, and its levels on terms of any length."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import divergence


def plain(rows, least=30, top=50):
    """The result by the contract's words, for rows of (lang, source, text)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = term.findall((text or "").translate(low))
        docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in counts if x == lang)

        def p(counted, kept=kept):
            total = sum(counted[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counted[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = p(sum((counts[lang, s] for s in sources), Counter()))
        ps = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-(ps[s][t] - q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and ps[s][t] > q[t]]
            out += [(lang, s, "pair", item, -v, i) for i, (v, _, item) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", item, -v, i) for i, (v, _, item) in enumerate(sorted(terms)[:top], 1)]
    return out


def same(df, found, **settings):
    rows = [tuple(r) for r in df.select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain(rows, **settings))


def test_documents(spark, sf):
    same(spark.read.parquet(f"{sf}/documents.parquet"), divergence.op12_source_divergence(spark, sf))


def test_awkward(spark, awkward):
    same(awkward, divergence.audit(awkward, least_documents=2), least=2)
    same(awkward, divergence.audit(awkward))


def test_nothing(spark, nothing):
    found = divergence.audit(nothing)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"] and found.count() == 0


def test_long_terms_and_shared_prefixes(spark):
    rng = random.Random(11)
    heads = ["a" * n for n in (3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 300)] + ["é" * n for n in (1, 2, 3, 4, 8, 16, 40)]
    rows = []
    for i in range(300):
        terms = [rng.choice(heads) + rng.choice(["", "b", "c", "Zz", "é", f"x{chr(97 + i % 26)}"]) for _ in range(rng.randrange(12))]
        rows.append((rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "c"]), " ".join(terms) + rng.choice(["", "!", " 12"])))
    rows += [("xx", "a", "once"), ("xx", "b", "twice"), ("xx", None, None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    for least in (1, 5, 30):
        same(df, divergence.audit(df, least_documents=least), least=least)


def test_small_chunks_and_shuffled_prefixes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SENT", 3)
    monkeypatch.setattr(divergence, "CHUNK", 40)
    rows = [("en", f"s{i % 3}", " ".join(f"word{chr(97 + j)}{'x' * (i * j % 9)}" for j in range(20))) for i in range(90)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    same(df, divergence.audit(df, least_documents=7, most_terms=4), least=7, top=4)


def test_shared_levels():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 16, 17, 40, 70]))).encode() for _ in range(400)} | {b"a" * n for n in range(1, 150)})
    rng.shuffle(names := list(terms))
    order = np.array([names.index(t) for t in terms])
    for i, shared in enumerate(divergence.shared_levels(names, order)):
        if i:
            a, b = terms[i - 1 : i + 1]
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared == sum(4 << k <= same for k in range(8))


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = divergence.audit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(con.execute(divergence.OP12_SQL).fetchall())
    assert found.filter(F.col("part") == "term").count() > 0
