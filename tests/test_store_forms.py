"""Versions of documents from a repeated stream, stores arranged for lookups, exports with ids, folders of several kinds."""

import os

from pyspark.sql import functions as F

from docloom.plans import jobs
from docloom.sources import documents as docs
from docloom.streaming import ingest, upserts

TEXT = "The plan number {} holds for every region here. "


def uploads(spark, rows):
    made = [(i, f"d{i}", None if t is None else TEXT.format(t) * 2, at) for i, t, at in rows]
    return spark.createDataFrame(made, "doc_id long, filename string, text string, at long").select("doc_id", "filename", "text", F.timestamp_seconds("at").alias("uploaded_at"))


def latest(spark, path):
    return sorted(((r.id, r.original_text, r.processed_text) for r in upserts.read_latest(spark, path).collect()), key=str)


def test_two_versions_and_a_replay_equal_the_batch(spark, tmp_path):
    first = uploads(spark, [(i, i, 1000) for i in range(20)])
    second = uploads(spark, [(i, i + 100, 2000) for i in range(0, 20, 3)])
    late = uploads(spark, [(3, "late", 500), (50, "new", 500), (50, None, 400), (None, "x", 100)])
    path, state = str(tmp_path / "store"), str(tmp_path / "state")
    for part in (first, second, late):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        upserts.start_upserts(ingest.read_uploads(spark, str(tmp_path / "in")), path, state).awaitTermination()
    final = uploads(spark, [(i, i + 100 if i % 3 == 0 else i, 0) for i in range(20)] + [(50, "new", 0), (None, "x", 0)])
    jobs.ingest_job(final, str(tmp_path / "batch"))
    want = sorted(((r.id, r.original_text, r.processed_text) for r in docs.read_store(spark, str(tmp_path / "batch")).collect()), key=str)
    assert latest(spark, path) == want and len(want) == 22
    # The second batch runs again, as after a failure between its write and the checkpoint.
    upserts.merge_batch(path)(second, 1)
    assert latest(spark, path) == want
    assert upserts.read_versions(spark, path).count() == 20 + 7 + 3
    upserts.compact(spark, path, str(tmp_path / "next"))
    assert latest(spark, str(tmp_path / "next")) == want and upserts.read_versions(spark, str(tmp_path / "next")).count() == 22


def test_a_batch_that_failed_half_way_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    merge = upserts.merge_batch(path)
    merge(uploads(spark, [(1, 1, 1)]), 0)
    half = uploads(spark, [(1, 2, 2), (2, 2, 2)]).withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    try:
        merge(half, 1)
        raise AssertionError("the batch should fail")
    except Exception as e:
        assert "lost" in str(e)
    assert [r[0] for r in latest(spark, path)] == ["1"] and "number 1" in latest(spark, path)[0][1]
    merge(uploads(spark, [(1, 2, 2), (2, 2, 2)]), 1)
    assert [r[0] for r in latest(spark, path)] == ["1", "2"] and "number 2" in latest(spark, path)[0][1]


def test_an_arranged_store_opens_one_folder(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("id"), F.lit("f").alias("filename"), F.concat(F.lit("text "), "id").alias("original_text"), F.lit("t").alias("processed_text"))
    store = docs.stored_form(rows.repartition(20), F.col("id"))
    docs.arrange_store(store, str(tmp_path / "s"), files=16)
    arranged = docs.read_arranged(spark, str(tmp_path / "s"))
    assert arranged.count() == 2000 and len([d for d in os.listdir(tmp_path / "s") if d.startswith("slot=")]) == 16
    found = docs.find_document(arranged, "77", files=16)
    assert [r.original_text for r in found.collect()] == ["text 77"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "EqualTo(id,77)" in plan
    assert len(found.inputFiles()) == len(arranged.inputFiles()) and found.select("id").filter("id is not null").count() == 1
    assert docs.find_document(arranged, "none", files=16).count() == 0
    wanted = spark.createDataFrame([("5",), ("1999",), ("5",), (None,), ("x",)], "id string")
    assert sorted(r.id for r in docs.find_documents(arranged, wanted, files=16).collect()) == ["1999", "5"]


def test_exports_keep_ids_and_borders(spark, tmp_path):
    rows = [(1, "a\nb\r\n\n"), (2, ""), (3, None), (None, 'quote " and \\ and   é'), (2, "again")]
    docs.export_documents(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "o"))
    assert sorted(map(tuple, docs.read_exported(spark, str(tmp_path / "o")).collect()), key=str) == sorted(rows, key=str)


def test_a_folder_of_several_kinds(spark, tmp_path):
    at = tmp_path / "mixed"
    (at / "below").mkdir(parents=True)
    (at / "one two+3.txt").write_text("first\ntext")
    (at / "below" / "notes.MD").write_text("# second")
    (at / "page.pdf").write_bytes(b"%PDF")
    (at / "noname").write_text("x")
    spark.createDataFrame([("t1", "third"), ("t2", None)], "filename string, text string").write.parquet(str(at / "table"))
    found, rejected = docs.scan_mixed(spark, str(at))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("one two+3.txt", "first\ntext"), ("notes.MD", "# second"), ("t1", "third"), ("t2", None)], key=str)
    assert sorted(map(tuple, rejected.collect())) == [("noname", ""), ("page.pdf", "pdf")]
