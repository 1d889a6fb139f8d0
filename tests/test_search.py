"""The search in cells against all cosines, with ties, nulls, rows without length and hot rows; how much it skips."""

import math
import random

import pytest

from docloom.operators import recommend, search


def cosine(q, r):
    dot = sum(a is not None and a == b for a, b in zip(q[1], r[1], strict=True)) + sum(a * b for a, b in zip(q[2], r[2], strict=True))
    base = q[3] * r[3]
    return dot / base if base > 0 else 0.0


def plain(queries, rows, n):
    out = []
    for q in queries:
        scored = [(cosine(q, r), r[0]) for r in rows if q[4] is None or r[0] != q[4]]
        scored.sort(key=lambda x: (round(-x[0], 9), -(x[1] if x[1] is not None else -1)))
        out += [(q[0], round(s, 6), k + 1) for k, (s, _) in enumerate(scored[:n])]
    return sorted(out, key=str)


def norm(cats, nums, known):
    return math.sqrt(known + sum(x * x for x in nums))


def tables(spark, queries, rows):
    kind = "cats array<string>, nums array<double>, norm double"
    return spark.createDataFrame(queries, f"query_id long, {kind}, own long"), spark.createDataFrame(rows, f"id long, {kind}").repartition(4)


def made(rng, n, m, width, level):
    rows = []
    for i in range(n):
        cats = [rng.choice(["a", "b", "c", None]) for _ in range(m)]
        nums = [round(rng.gauss(0, 1), level) for _ in range(width)]
        rows.append((rng.choice([i, i, i, None, 7]), cats, nums, norm(cats, nums, m)))
    return rows


def asked(rng, n, m, width, level):
    out = []
    for i in range(n):
        cats = [rng.choice(["a", "b", "zz", None]) for _ in range(m)]
        nums = [round(rng.gauss(0, 1), level) for _ in range(width)]
        known = sum(c in ("a", "b") for c in cats)
        out.append((i, [c if c in ("a", "b") else None for c in cats], nums, norm(cats, nums, known), rng.choice([None, 7, i])))
    return out


@pytest.mark.parametrize("m,width,level", [(2, 1, 1), (0, 8, 3), (1, 3, 0), (3, 0, 1)])
def test_as_all_cosines(spark, m, width, level):
    rng = random.Random(m + width)
    rows = made(rng, 1500, m, width, level)
    rows += [rows[0]] * 700 + ([(9000, [], [0.0] * width, 0.0)] if not m else [])
    queries = asked(rng, 40, m, width, level) + ([(90, [None] * m, [0.0] * width, 0.0, None)] if width else [])
    q, r = tables(spark, queries, rows)
    found = search.nearest_rows(q, r, 5).collect()
    assert sorted(((x.query_id, round(x.similarity, 6), x.rank) for x in found), key=str) == plain(queries, rows, 5)
    by = {q[0]: q for q in queries}
    sims = {}
    for x in rows:
        sims.setdefault(x[0], []).append(x)
    for x in found:
        assert any(abs(cosine(by[x.query_id], row) - x.similarity) < 1e-9 for row in sims[x.id])
        assert x.id is None or x.id != by[x.query_id][4]


def test_ties_go_by_descending_id(spark):
    rows = [(i, ["a"], [1.0], math.sqrt(2)) for i in range(9000)] + [(None, ["a"], [1.0], math.sqrt(2))]
    q, r = tables(spark, [(1, ["a"], [1.0], math.sqrt(2), None), (2, ["a"], [1.0], math.sqrt(2), 8999)], rows)
    found = search.nearest_rows(q, r, 3).collect()
    assert sorted((x.query_id, x.rank, x.id) for x in found) == [(1, 1, 8999), (1, 2, 8998), (1, 3, 8997), (2, 1, 8998), (2, 2, 8997), (2, 3, 8996)]


def test_fewer_rows_than_asked_and_none(spark):
    q, r = tables(spark, [(1, [], [1.0, 0.0], 1.0, None)], [(1, [], [1.0, 1.0], math.sqrt(2)), (None, [], [0.0, 0.0], 0.0)])
    assert [(x.id, x.rank) for x in sorted(search.nearest_rows(q, r, 5).collect(), key=lambda x: x.rank)] == [(1, 1), (None, 2)]
    assert search.nearest_rows(q, r.limit(0), 5).collect() == [] and search.nearest_rows(q.limit(0), r, 5).collect() == []


def test_most_cells_are_skipped(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        c = [float(x) for x in random.Random(i % 40).choices([-3, 0, 3], k=12)]
        nums = [x + rng.gauss(0, 0.2) for x in c]
        rows.append((i, [], nums, norm([], nums, 0)))
    queries = [(i, [], rows[i][2], rows[i][3], i) for i in range(0, 6000, 60)]
    looked = []
    monkeypatch.setattr(search, "CELL", 25)
    real = search._needed

    def counted(asked, cells, n, again):
        met = real(asked, cells, n, again)
        looked.append((met.count(), asked.count() * len(cells.number)))
        return met

    monkeypatch.setattr(search, "_needed", counted)
    q, r = tables(spark, queries, rows)
    found = search.nearest_rows(q, r, 5)
    assert sorted(((x.query_id, round(x.similarity, 6), x.rank) for x in found.collect()), key=str) == plain(queries, rows, 5)
    assert len(looked) == 2 and sum(met for met, _ in looked) < 0.25 * looked[0][1]


def test_nulls_in_queries_and_history(spark):
    hist = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "a", 2.0, "y"), (None, "b", 3.0, "x"), (None, "b", 3.0, "y"), (4, None, 4.0, "x"), (5, "a", None, "y")], "id long, c string, v double, label string")
    asks = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (3, "zz", None), (None, "b", 3.0)], "query_id long, c string, v double")
    top = recommend.nearest(asks, hist, ["c"], ["v"]).collect()
    assert {r.query_id for r in top} == {1, 2, 3, None} and all(r.id != 5 for r in top) and len(top) == 20
    assert all(r.similarity == 0 for r in top if r.query_id == 3)
    scored = recommend.similarity(asks, hist.filter("v is not null"), ["c"], ["v"], "id")
    assert scored.count() == 20 and scored.filter("similarity is null").count() == 0
    assert recommend.recommend(asks, hist, ["c"], ["v"], "label").count() == 4


def test_rings_hold_like_numbers_and_rows_are_sent_once(spark, monkeypatch):
    """Rows on a short arc, many queries: cells are of about CELL rows each, and a bin goes to as many tasks as its own queries ask for."""
    rng = random.Random(4)
    rows = [(i, ["a"], [x], norm(["a"], [x], 1)) for i, x in enumerate(rng.uniform(0, 0.3) for _ in range(20_000))]
    queries = [(i, *rows[i][1:], None) for i in range(0, 20_000, 20)]
    monkeypatch.setattr(search, "CHUNK", 400)
    cells, sent = [], []
    measure, chunked = search._measure, search._chunked

    def measured(celled, made):
        measure(celled, made)
        cells.append(made.rows)

    def counted(needed, bins):
        met = chunked(needed, bins)
        sent.append(met.select("bin", "chunks").distinct().agg({"chunks": "max"}).first()[0])
        return met

    monkeypatch.setattr(search, "_measure", measured)
    monkeypatch.setattr(search, "_chunked", counted)
    q, r = tables(spark, queries, rows)
    found = {x.query_id: x.similarity for x in search.nearest_rows(q, r, 5).collect() if x.rank == 1}
    assert len(found) == 1000 and min(found.values()) > 1 - 1e-9
    assert max(cells[0]) < 4 * search.CELL and len(sent) == 2 and sent[0] <= 2
