"""Reports and summary jobs read whole texts where asked to."""

from docloom.plans import jobs

TEXT = " ".join(f"word{i} stands in place {i} here." for i in range(200)) + " " + " ".join(f"Carbon rules matter item{i}." for i in range(400))


def test_summaries_of_whole_texts(spark):
    d = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    names = spark.createDataFrame([("Nowhere", "GPE")], "name string, label string")
    assert len(TEXT) > 4000 and "carbon" not in TEXT[:4000].lower()
    for made in (lambda n: jobs.summarize_job(d, max_input=n), lambda n: jobs.policy_report(d, names, max_input=n)):
        first, whole = ({r.doc_id: r.summary for r in made(n).collect()} for n in (4000, None))
        assert "carbon" not in first[1].lower() and "carbon" in whole[1].lower()
        assert first.keys() == whole.keys() == {1, 2, 3}
