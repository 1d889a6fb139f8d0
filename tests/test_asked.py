"""Searches take the whole stated set of queries."""

from docloom.plans.queries import QUERIES
from docloom.session import table


def test_every_hundredth_order_is_searched(spark, sf):
    asked = {r.o_orderkey for r in table(spark, sf, "orders").filter("o_orderkey % 100 = 0").collect()}
    best = QUERIES["r4_top_similar_all"](spark, sf).collect()
    assert len(asked) > 0 and {r.query_id for r in best} == asked and len(best) == 5 * len(asked)
    assert {r.query_id for r in QUERIES["r6_recommend_all"](spark, sf).collect()} == asked


def test_nearest_equals_ranked_similarities(spark, monkeypatch):
    from docloom.operators import recommend

    rows = [(i, "AB"[i % 2], i % 3, float(i % 7)) for i in range(90)] + [(100 + i, "A", 1, 3.0) for i in range(30)] + [(200, None, 2, 1.0)]
    hist = spark.createDataFrame(rows, "id long, location string, month int, heat double").repartition(5)
    asked = spark.createDataFrame([(1, "A", 1, 3.0), (2, "nowhere", 9, 2.5), (3, None, None, 6.0), (4, "B", 2, 0.0)], "query_id long, location string, month int, heat double")
    args = (["location", "month"], ["heat"])
    for block in (2000, 3):
        monkeypatch.setattr(recommend, "QUERY_BLOCK", block)
        want = sorted(map(tuple, recommend.top_similar(recommend.similarity(asked, hist, *args, "id")).collect()))
        got = sorted(map(tuple, recommend.nearest(asked, hist, *args).select("query_id", "id", "similarity", "rank").collect()))
        assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
        assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want, strict=True))
    assert recommend.nearest(asked.limit(0), hist, *args).count() == 0 and recommend.nearest(asked, hist.limit(0), *args).count() == 0
