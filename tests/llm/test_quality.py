"""Measures against plain Python; host verdicts by hand."""

import collections
import random
import re

import duckdb

from docloom.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if c[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), dup, len(covered), failed


def test_measures(spark, awkward):
    rng = random.Random(0)
    texts = [None, "", " ", "\n\n", " a b c a b c\x0b d\n\n a b c", "x", "a\xa0b\x85c 😀 é"]
    texts += [" ".join(rng.choice("abc#") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["\n".join(rng.choice(["aa b", "c", "", " "]) for _ in range(20)) for _ in range(20)]
    texts += [r.text for r in awkward.collect()]
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.measures(d).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_hosts(spark, awkward, nothing):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad, "poor") for i in range(38)] + [(200, good, "poor"), (201, good, "poor"), (300, good, None), (301, bad, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in Q.judge(d).collect() if r.kept}
    assert set(range(40)) <= kept and not kept & {*range(100, 202), 301}
    odd = Q.judge(awkward)
    assert odd.count() == awkward.count() and Q.judge(nothing).count() == 0
    assert {r.kept for r in odd.filter("base_failed").collect()} == {False}


def test_small_hosts_lean_on_the_corpus(spark):
    rows = [(i, i % 100 < 10, f"h{i % 50}") for i in range(5000)] + [(9000, True, "tiny")]
    m = spark.createDataFrame(rows, "id long, base_failed boolean, host string")
    rates = {r.host: r.rate for r in Q.host_rates(m).collect()}
    assert rates["tiny"] < 0.9 and abs(rates["h20"] - 0.0) < 0.05


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, Q.op6_quality(spark, "/root/testdata/sf0.001").collect())) == sorted(con.execute(Q.OP6_SQL).fetchall())


def test_sql_where_host_verdicts_fire(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{good} {i}", "fine") for i in range(60)] + [(100 + i, "too short", "poor") for i in range(40)] + [(200 + i, f"{good} {i}", "poor") for i in range(6)] + [(300 + i, good if i % 3 else None, None) for i in range(30)] + [(400, "one", "tiny"), (401, good, "tiny")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, Q.op6_quality(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(Q.OP6_SQL).fetchall())
    assert sum(not r[6] and not r[7] for r in got) == 6, "the host takes its fine documents with it"
