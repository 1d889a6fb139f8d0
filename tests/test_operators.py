"""Operators on small rows with known results."""

import math

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.operators import classify, compare, entities, explode, recommend, stats
from docloom.plans import jobs
from docloom.sources import documents as docs
from docloom.streaming import ingest

DOCS = "doc_id long, text string"


def test_statistics(spark):
    d = spark.createDataFrame([(1, "Act now. Emissions rose 2.5% in 2030! See https://x.y"), (2, ""), (3, None)], DOCS)
    rows = {r.doc_id: tuple(r)[1:] for r in stats.document_statistics(d).collect()}
    assert rows == {1: (15, 5, 3.0), 2: (0, 1, 0.0), 3: (0, 1, 0.0)}


def test_sections_and_sentences(spark):
    d = spark.createDataFrame([(1, "One plan.\n\nNothing.\n\nA law. Here"), (2, "A. B. C."), (3, "one")], DOCS)
    s = {r.doc_id: (r.section1, r.section2) for r in explode.split_policy_sections(d).collect()}
    assert s == {1: ("One plan.", "A law. Here"), 2: ("A.", "B. C."), 3: ("", "one")}
    assert [r.sentence for r in explode.split_sentences(d.filter("doc_id = 2")).orderBy("pos").collect()] == ["A.", "B.", "C."]
    tail = spark.createDataFrame([(1, "A. ")], DOCS)
    assert [r.sentence for r in explode.split_sentences(tail).orderBy("pos").collect()] == ["A.", ""]


def test_categories(spark):
    d = spark.createDataFrame([(1, "We reduce emissions by 2030. The impact grows. Nothing"), (2, None)], DOCS)
    got = {(r.category, r.pos) for r in classify.classify_sentences(d).collect()}
    assert got == {("Mitigation_Targets", 0), ("Targets_Timelines", 0), ("Legislation_Policies", 1)}
    assert "Legislation_Policies" not in {r.category for r in classify.classify_sentences(d, whole_word=True).collect()}
    assert {(r.category, r.n) for r in classify.category_counts(d).collect()} == {("Mitigation_Targets", 1), ("Targets_Timelines", 1), ("Legislation_Policies", 1)}
    lists = {r.doc_id: r for r in classify.policy_analysis(d).collect()}
    assert lists[1].Legislation_Policies == ["The impact grows."] and all(lists[2][c] == [] for c in R.CATEGORY_ORDER)


def test_rule_table_equals_default_rules(spark):
    d = spark.createDataFrame([(1, "We reduce emissions. A net zero law, funding and renewable energy."), (2, "x")], DOCS)
    table = spark.createDataFrame([(c, w) for c, ws in R.CATEGORIES.items() for w in ws], "category string, keyword string")
    assert sorted(classify.classify_by_rules(d, table).collect()) == sorted(classify.classify_sentences(d).collect())
    assert classify.classify_by_rules(d, table.limit(0)).count() == 0


def test_impacts(spark):
    d = spark.createDataFrame([(1, "Warming and heat increase with higher rainfall"), (2, "cooling will reduce and lower"), (3, "increase")], DOCS)
    rows = {r.doc_id: tuple(round(x, 4) for x in tuple(r)[1:]) for r in classify.climate_impacts(d).collect()}
    assert rows[1] == (0.6667, 0.6667, 0.0) and rows[2] == (-1.0, 0.0, 0.0) and rows[3] == (0.0, 0.0, 0.0)


def test_compare_golden(spark):
    a, b = "The government will reduce emissions by 2030 through renewable energy and carbon tax", "Emissions fall by 2030"
    d = spark.createDataFrame([(1, 2, a, b), (3, 4, a, a)], "id_a long, id_b long, text_a string, text_b string")
    rows = {r.id_a: r for r in compare.compare_tokens(d, ["id_a", "id_b"]).collect()}
    assert rows[1].overlap == ["2030", "by", "emissions"] and rows[1].unique_b == ["fall"]
    assert rows[3].unique_a == [] and rows[3].unique_b == []
    for r in rows.values():
        assert len(r.overlap) + len(r.unique_a) == len(set(a.lower().split()))
    counts = compare.overlap_counts(compare.compare_tokens(d, ["id_a", "id_b"]), ["id_a", "id_b"]).collect()
    assert {(r.id_a, r.part, r.n) for r in counts} >= {(1, "Overlap", 3), (3, "Unique A", 0)}


def test_text_similarity(spark):
    d = spark.createDataFrame([(1, "a b b"), (2, "a b b"), (3, "c"), (4, "")], DOCS)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "id_a long, id_b long")
    rows = {r.id_b: r.similarity for r in compare.text_similarity(d, pairs).collect()}
    assert math.isclose(rows[2], 1.0) and rows[3] == 0.0 and rows[4] == 0.0
    same = {r.id_b: r for r in compare.compare_policy(spark.createDataFrame([(1, "a long text €"), (2, "a long text"), (3, "short")], DOCS), pairs).collect()}
    assert list(same) == [2] and math.isclose(same[2].similarity, 1.0) and same[2].overlap == ["a", "long", "text"]


def test_vector_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in d.select(compare.vector_cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]


def test_entities(spark):
    gaz = spark.createDataFrame([("South Africa", "GPE"), ("Africa", "GPE")], "name string, label string")
    d = spark.createDataFrame([(1, "On 5 March 2031 south africa paid $5bn, 20% of 7."), (2, None), (3, "")], DOCS)
    got = {(r.text, r.label, r.start, r.end) for r in entities.extract_entities(d, gaz, offsets=True).collect()}
    text = "On 5 March 2031 south africa paid $5bn, 20% of 7."
    assert {(t, label) for t, label, _, _ in got} == {("5 March 2031", "DATE"), ("south africa", "GPE"), ("africa", "GPE"), ("$5bn", "MONEY"), ("20%", "PERCENT"), ("7", "CARDINAL")}
    assert all(text[a:b] == t for t, _, a, b in got)
    assert entities.affected_regions(entities.extract_entities(d, gaz)).first().regions == ["africa", "south africa"]
    assert entities.top_entities(entities.extract_entities(d, gaz), 1).filter("label = 'GPE'").first().text == "africa"


def test_keywords_and_phrases(spark):
    d = spark.createDataFrame([(1, "The solar power plan and the solar roof 2030")], DOCS)
    assert entities.keywords(d).first().keywords == ["plan", "power", "roof", "solar"]
    phrases = {r.phrase: r.score for r in entities.key_phrases(d).collect()}
    # solar stands in phrases of three words each: (3 + 3) / 2.
    assert phrases == {"solar power plan": 3.0, "solar roof 2030": 3.0}


def test_summary(spark):
    d = spark.createDataFrame([(1, "Water water water. Stone. Water flows."), (2, ""), (3, "One two.")], DOCS)
    rows = {r.doc_id: r.summary for r in entities.summarize(d, max_words=4).collect()}
    assert rows == {1: "Water water water.", 2: "", 3: "One two."}
    assert entities.summarize(d.filter("doc_id = 1"), max_words=100).first().summary == "Water water water. Stone. Water flows."


def history(spark):
    rows = [(i, "AB"[i % 2], i % 3 + 1, float(i), 50 + i, i / 2, "Sunny" if i % 4 else "Rain") for i in range(40)]
    return spark.createDataFrame(rows, "id long, location string, month int, temperature_c double, humidity_pct int, wind_kmh double, condition string")


def brute(query, rows, n):
    """Cosine over one-hot and standardised columns, as vectors."""
    cats = [sorted({r[c] for r in rows}) for c in ("location", "month")]
    stat = {}
    for c in ("temperature_c", "humidity_pct", "wind_kmh"):
        v = [r[c] for r in rows]
        m = sum(v) / len(v)
        stat[c] = (m, (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5 or 1.0)

    def vec(r):
        return [float(r[c] == k) for c, ks in zip(("location", "month"), cats, strict=True) for k in ks] + [(r[c] - m) / s for c, (m, s) in stat.items()]

    def cos(a, b):
        d = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / d if d else 0.0

    best = sorted(((cos(vec(query), vec(r)), r["id"], r["condition"]) for r in rows), reverse=True)[:n]
    votes = {}
    for s, _, c in best:
        votes[c] = votes.get(c, 0) + s
    label = max(votes, key=votes.get)
    return [i for _, i, _ in best], label, votes[label] / (sum(votes.values()) or 1)


def test_recommend_equals_vectors(spark):
    hist = history(spark)
    asked = [{"query_id": 1, "location": "A", "month": 2, "temperature_c": 11.0, "humidity_pct": 70, "wind_kmh": 3.0}, {"query_id": 2, "location": "nowhere", "month": 1, "temperature_c": 30.0, "humidity_pct": 60, "wind_kmh": 9.0}]
    q = spark.createDataFrame([tuple(a.values()) for a in asked], "query_id int, location string, month int, temperature_c double, humidity_pct int, wind_kmh double")
    got = {r.query_id: r for r in recommend.recommend(q, hist, ["location", "month"], ["temperature_c", "humidity_pct", "wind_kmh"], "condition").collect()}
    rows = [r.asDict() for r in hist.collect()]
    for a in asked:
        ids, label, confidence = brute(a, rows, 5)
        r = got[a["query_id"]]
        assert [t.id for t in r.top] == ids and r.predicted == label and math.isclose(r.confidence, confidence) and r.message == R.RECOMMENDATION


def test_query_blocks_agree(spark, monkeypatch):
    hist = history(spark)
    q = hist.select(F.col("id").alias("query_id"), "location", "month", "temperature_c", "humidity_pct", "wind_kmh")
    args = (["location", "month"], ["temperature_c", "humidity_pct", "wind_kmh"], "id")
    whole = sorted(recommend.top_similar(recommend.similarity(q, hist, *args)).collect())
    monkeypatch.setattr(recommend, "QUERY_BLOCK", 7)
    assert sorted(recommend.top_similar(recommend.similarity(q, hist, *args)).collect()) == whole


def test_model_round_trip(spark, tmp_path):
    hist = history(spark)
    first = recommend.load_or_fit_model(spark, hist, ["location"], ["temperature_c"], str(tmp_path / "m"))
    again = recommend.load_or_fit_model(spark, hist.limit(1), ["location"], ["temperature_c"], str(tmp_path / "m"))
    assert first[0].collect() == again[0].collect() and first[0].first().temperature_c_mean == 19.5
    assert sorted(r.value for r in again[1].collect()) == ["A", "B"]


def test_valid_query(spark):
    q = spark.createDataFrame([("a", 1, 1.0, 0, 0.0), ("a", 13, 1.0, 0, 0.0), ("a", 1, 1.0, 101, 0.0), ("a", 1, 1.0, 5, -1.0), (None, 1, 1.0, 5, 1.0), ("a", 1, None, 5, 1.0)], "location string, month int, temperature_c double, humidity_pct int, wind_kmh double")
    good, bad = docs.split_valid(q, recommend.valid_query(q))
    assert (good.count(), bad.count()) == (1, 5)


def test_read_samples_and_scan(spark, tmp_path):
    (tmp_path / "w.csv").write_text("location,month,temperature_c,humidity_pct,wind_kmh,condition\nJaffna,11,29.4,88,8.3,Cloudy\n")
    assert tuple(docs.read_samples(spark, str(tmp_path / "w.csv")).first()) == ("Jaffna", 11, 29.4, 88, 8.3, "Cloudy")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one\ntwo")
    assert tuple(docs.scan_documents(spark, str(tmp_path / "d")).first()) == ("a.txt", "one\ntwo")
    with pytest.raises(ValueError):
        docs.scan_documents(spark, "x", "pdf")


def test_assemble(spark):
    d = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, "")], "k long, o long, t string")
    got = {m: {r.k: r.text for r in docs.assemble_pages(d, ["k"], "o", "t", mode=m).collect()} for m in ("terminated", "nonempty", "joined")}
    assert got == {"terminated": {1: "a\nb\n\n", 2: "\n"}, "nonempty": {1: "a\nb\n", 2: ""}, "joined": {1: "a\nb\n", 2: ""}}


def test_store(spark, tmp_path):
    d = spark.createDataFrame([("a", "x.txt", "1234", "12"), ("b", "y.txt", "", "")], "id string, filename string, original_text string, processed_text string")
    docs.store_documents(d, str(tmp_path / "s"), F.col("id"))
    store = docs.read_store(spark, str(tmp_path / "s"))
    assert docs.get_document(store, "a").first().metadata.compression_ratio == 0.5
    assert docs.get_document(store, "none").count() == 0
    assert [r.metadata.compression_ratio for r in docs.list_documents(store).collect()] == [0.5, 0.0]
    docs.export_text(d, str(tmp_path / "out"), "id", "processed_text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "12"]


def test_preview_lines(spark):
    d = spark.createDataFrame([(1, "a\nb\nc"), (2, "")], DOCS)
    assert [tuple(r) for r in docs.preview_lines(d, 2).orderBy("doc_id").collect()] == [(1, "a\nb", 2, 3), (2, "", 1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"d{i}", f"The plan number {i} holds for every region here. " * 2) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, filename string, text string").withColumn("uploaded_at", F.timestamp_seconds(F.lit(100_000) + F.col("doc_id")))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    d.filter("doc_id < 5").write.mode("append").parquet(str(tmp_path / "in"))
    jobs.ingest_job(d, str(tmp_path / "batch"))
    for _ in range(2):  # a second start finds nothing new
        ingest.start_ingest(ingest.read_uploads(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path / "stream"), str(tmp_path / "state")).awaitTermination()
    a, b = (sorted((r.id, r.processed_text) for r in docs.read_store(spark, str(tmp_path / p)).collect()) for p in ("batch", "stream"))
    assert a == b and len(a) == 20


def test_reports(spark):
    gaz = spark.createDataFrame([("France", "GPE")], "name string, label string")
    d = spark.createDataFrame([(1, "France has a climate policy. It will reduce emissions by 2030.")], DOCS)
    r = jobs.policy_report(d, gaz).first()
    assert r.word_count == 11 and r.entities == "GPE:France|DATE:2030" and r.Mitigation_Targets == ["It will reduce emissions by 2030."]
    assert jobs.text_report(d, gaz).first().sentence_count == 2
    assert jobs.preprocess_job(spark.createDataFrame([(1, " "), (2, "a b.")], DOCS)).select("doc_id", "statistics.word_count").collect()[0][:] == (2, 3)
    full = jobs.full_analysis(d, gaz, history(spark), spark.createDataFrame([(0, "A", 8, 28.0, 75, 12.0)], "query_id int, location string, month int, temperature_c double, humidity_pct int, wind_kmh double")).first()
    assert full.recommendation.predicted in ("Sunny", "Rain") and [e.text for e in full.entities] == ["France", "2030"]
