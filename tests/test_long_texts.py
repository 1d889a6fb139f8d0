"""Long texts take time in proportion, and nothing is cut off by a bound of the code."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import classify, compare, entities


def seconds(spark, f, text):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).cache()
    d.count()
    best = []
    for _ in range(2):
        began = time.time()
        f(d).write.format("noop").mode("overwrite").save()
        best.append(time.time() - began)
    d.unpersist()
    return min(best)


def column(g):
    return lambda d: d.select(g(F.col("text")))


GAZETTEER = [("South Korea", "GPE"), ("Korea", "GPE")]
CASES = {
    "strip": (column(T.strip), lambda n: "a" + " " * n + "b"),
    "hyphen": (column(T.join_hyphenated), lambda n: "a" * n),
    "hyphen_lines": (column(T.join_hyphenated), lambda n: "a-" + "\n" * n + "!"),
    "preprocess": (column(T.preprocess_text), lambda n: "a " + "# " * (n // 2) + "b"),
    "numbers": (column(T.normalize_numeric_and_dates), lambda n: "1" * n + " percent of % mtco2 billion"),
    "boundaries": (column(T.fix_sentence_boundaries), lambda n: "a" + "\n" * n + "b"),
    "patterns": (lambda d: entities.pattern_entities(d), lambda n: "7 a " * (n // 4)),
    "names": (lambda d: entities.name_entities(d, d.sparkSession.createDataFrame(GAZETTEER, "name string, label string")), lambda n: "in south korea " * (n // 15)),
    "summary": (lambda d: entities.summarize(d, max_input=None), lambda n: " ".join(f"w{i % 5000} is here." for i in range(n // 14))),
    "counts": (lambda d: d.select(compare.run_counts(T.tokenize_words(F.col("text")))), lambda n: " ".join(str(i) for i in range(n // 7))),
}


@pytest.mark.parametrize("case", CASES)
def test_twice_the_text_takes_about_twice_the_time(spark, case):
    f, make = CASES[case]
    seconds(spark, f, make(1000))
    small, large = (seconds(spark, f, make(n)) for n in (500_000, 1_000_000))
    assert large < 2.5 * small + 0.8, (small, large)


def test_linear_patterns_give_what_the_plain_ones_give(spark):
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bc", "-", "\n", " ", "\n\n", ".", "!", "X", "\t", "1"]) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in d.select("i", "t", T.join_hyphenated(F.col("t")).alias("h"), T.strip(F.col("t")).alias("s"), T.preprocess_text(F.col("t")).alias("p"), T.replace(F.col("t"), T.R.SENTENCE_BOUNDARIES[-1][0], r"\1. \2").alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i].h == re.sub(r"(\w+)-\s*\n\s*(\w+)", r"\1\2", t)
        assert got[i].s == t.strip()
        kept = re.sub(r"[^\w\s.,;?!-]", "", re.sub(r"\s+", " ", t).strip())
        assert got[i].p == re.sub(r"\s*([.!?])\s*", r" \1 ", kept).strip()
        assert got[i].b == re.sub(r"([a-zA-Z])\s*\n\s*([A-Z])", r"\1. \2", t)


def test_running_sums_and_runs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(0, 3) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 7, 64, 1000])] + [(99, None)]
    d = spark.createDataFrame(rows, "i int, x array<int>")
    for r in d.select("x", T.running_sums(F.col("x")).alias("s"), T.runs(F.sort_array("x")).alias("r")).collect():
        if r.x is None:
            assert r.s is None and r.r is None
            continue
        assert r.s == [sum(r.x[: k + 1]) for k in range(len(r.x))]
        s = sorted(r.x)
        assert [(a.at, a.n) for a in r.r] == [(s.index(v), s.count(v)) for v in sorted(set(s))]


def test_rule_tables_of_any_size(spark):
    keywords = [("one", f"kw{i}x") for i in range(5000)] + [(f"c{i % 30}", f"word{i}x") for i in range(510)] + [("one", None), ("one", "kw7x")]
    rules = spark.createDataFrame(keywords, "category string, keyword string")
    d = spark.createDataFrame([(1, "A kw7x and kw4999x here. Also word509x."), (1, "A kw7x and kw4999x here. Also word509x."), (2, None), (3, "")], "doc_id long, text string")
    want = [(1, "one", 0), (1, f"c{509 % 30}", 1)] * 2
    assert sorted((r.doc_id, r.category, r.pos) for r in classify.classify_by_rules(d, rules).collect()) == sorted(want)
    few = spark.createDataFrame([("one", f"kw{i}x") for i in range(9)] + [("two", "kw7x")], "category string, keyword string")
    whole = sorted(map(tuple, classify.classify_by_rules(d, few).collect()))
    assert whole == sorted(map(tuple, classify.classify_by_rules(d, few, block=2, blocks=2).collect())) and len(whole) == 4


def test_names_of_any_number_of_words(spark):
    names = spark.createDataFrame([("The United Kingdom of Great Britain and Northern Ireland", "GPE"), ("great britain", "GPE"), ("U.S.", "GPE"), ("co-op", "ORG"), ("!!", "ORG")], "name string, label string")
    text = "In the united kingdom of Great Britain and Northern Ireland, the U.S. co-op and Great  Britain."
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, "co-op")], "doc_id long, text string")
    got = sorted((r.start, r.text, r.end) for r in entities.name_entities(d, names).collect() if r.text != "co-op" or r.start)
    assert [t for _, t, _ in got] == ["the united kingdom of Great Britain and Northern Ireland", "Great Britain", "U.S", "co-op"]
    assert all(text[a:b] == t for a, t, b in got)
    assert entities.name_entities(d, names.limit(0)).count() == 0


def test_neighbours_of_a_hot_group(spark):
    from pyspark.sql.window import Window

    rows = [(i, "hot") for i in range(3000)] + [(5000 + i, f"g{i % 40}") for i in range(400)] + [(9000 + i, None) for i in range(50)] + [(None, "hot")]
    d = spark.createDataFrame(rows, "doc_id long, g string").repartition(8)
    after = F.lead("doc_id").over(Window.partitionBy("g").orderBy("doc_id"))
    want = {tuple(r) for r in d.filter("doc_id is not null").select("doc_id", after.alias("b")).filter("b is not null").collect()}
    assert {tuple(r) for r in compare.neighbour_pairs(d, ["g"]).collect()} == want and len(want) == 3000 + 400 + 50 - 42


def test_pairs_by_token_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 30))]
        rows += [(4 * i + k, " ".join(w for w in base if k == 0 or rng.random() > 0.07 * k)) for k in range(4)]
    rows += [(1000 + i, "same words for everyone in here") for i in range(70)]
    sets = {}
    for i, t in rows:
        if t:
            sets.setdefault(frozenset(t.split()), i)
    want = {(min(i, j), max(i, j), len(a & b)) for a, i in sets.items() for b, j in sets.items() if i < j and len(a & b) >= 0.8 * len(a | b)}
    got = {tuple(r) for r in compare.pairs_by_token(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) > 15


def test_repeated_ids_are_one_document(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "a b b c"), (3, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    rows = {r.id_b: r.similarity for r in compare.text_similarity(d, pairs).collect()}
    assert rows[2] > 0.9 and rows[3] == 0.0


def test_scan_by_suffix(spark, tmp_path):
    from docloom.sources import documents as docs

    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    (tmp_path / "t/b.md").write_text("three")
    assert sorted(map(tuple, docs.scan_documents(spark, str(tmp_path / "t")).collect())) == [("a.txt", "one\ntwo"), ("b.md", "three")]
    spark.createDataFrame([("x", "y")], "filename string, text string").write.parquet(str(tmp_path / "p.parquet"))
    assert tuple(docs.scan_documents(spark, str(tmp_path / "p.parquet")).first()) == ("x", "y")
    (tmp_path / "t/c.docx").write_text("no")
    for path in ("t", "t/c.docx"):
        with pytest.raises(ValueError, match="docx"):
            docs.scan_documents(spark, str(tmp_path / path))


def test_summary_length(spark):
    text = " ".join(f"Water is number {i}." for i in range(100))
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    words = {r.doc_id: len((r.summary or "").split()) for r in entities.summarize(d, max_words=10, min_words=30).collect()}
    assert 30 <= words[1] < 34 and words[3] == 0
    assert len(entities.summarize(d, max_words=10).first().summary.split()) <= 10
    late = "One two three. " * 400 + "Water water water water."
    assert entities.summarize(spark.createDataFrame([(1, late)], "doc_id long, text string"), max_input=None, max_words=3).first().summary == "One two three."
    assert "Water" in entities.summarize(spark.createDataFrame([(1, "A b. " * 1000 + "Zz. " + "Water " * 1500 + "end.")], "doc_id long, text string"), max_input=None, max_words=4).first().summary
