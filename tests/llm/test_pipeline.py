"""The pipeline's stages on a small corpus, each against its own input."""

import corpus_pipeline as P
from docloom.llm.common import materialize
from docloom.llm.decontaminate import find_leaks

SF = "/root/testdata/sf0.001"


def alike_kept(rows):
    """The smallest id of each group of texts that are in turn alike at 0.8 over five-word shingles, by comparing all pairs."""
    rows = sorted(rows)
    sets, up = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF), "test")
        assert after.columns == columns
        if name != "mixing":
            assert after.exceptAll(docs).count() == 0
        if name == "near_dedup":
            assert sorted(r.doc_id for r in after.collect()) == alike_kept([(r.doc_id, r.text) for r in docs.collect()])
        if name == "decontamination":
            leaks = {r.doc_id for r in find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()} == leaks
        seen.append(after.count())
        docs = after
    out = P.STAGES[-1][1](spark, docs, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == seen[-1]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in P.run(spark, SF).collect()) == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out.collect())


def test_awkward_tables(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no id here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (awkward, nothing):
        docs = given
        for _, stage in P.STAGES[:-1]:
            docs = materialize(stage(spark, docs, str(tmp_path)), "test")
            assert docs.columns == given.columns
        assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_entry_registers_all():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in e.queries()} and "pipeline" in e.queries()
