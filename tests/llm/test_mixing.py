"""Targets by hand, taken words near them, and reruns that agree."""

import random
from collections import defaultdict

from docloom.llm import mixing as M


def plain_targets(sizes):
    """Water filling: share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, got, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = total - sum(got[s] for s in sizes if s not in open_)
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return got | {s: level * weight[s] for s in open_}
        got |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return got


def documents(spark, n=3000):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)), rng.choice(["hot"] * 8 + ["a", "b", "é", None, "Z"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 64)
    monkeypatch.setattr(M, "FAN_IN", 4)
    rows, d = documents(spark)
    got = M.mix(d).collect()
    assert {r.doc_id: r.size for r in got} == {i: len(t.split()) for i, t, _ in rows}
    source, sizes, taken, largest = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
    goal = plain_targets(sizes)
    for r in got:
        assert abs(r.target - goal[source[r.doc_id]]) < 1e-6 * goal[source[r.doc_id]] and r.source_size == sizes[source[r.doc_id]]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s]
    again = M.mix(d.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_chances_are_kept():
    n, taken = 400, 0.0
    for seed in range(n):
        rows = [(i, (str(i), 0), size, 0.3) for i, size in enumerate([5, 3, 8, 1, 2])]
        out = dict(M.pivot(iter(rows), seed))
        assert sum(0 < p < 1 for p in out.values()) <= 1
        assert abs(sum(p * r[2] for r, p in zip(rows, (out[i] for i in range(5)), strict=True)) - 0.3 * 19) < 1e-6
        taken += out[2]
    assert abs(taken / n - 0.3) < 0.08


def test_awkward_rows(spark, awkward, nothing):
    got = M.mix(awkward).collect()
    assert len(got) == awkward.count() and all(r.taken == 0 for r in got if r.size == 0)
    assert M.mix(nothing).count() == 0 and M.mixed_documents(nothing).count() == 0
    m = M.mixed_documents(awkward)
    assert m.columns == awkward.columns and {r.doc_id for r in m.collect()} <= {r.doc_id for r in awkward.collect()}
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in M.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_documents_come_as_often_as_taken(spark):
    rows, d = documents(spark, 400)
    want = {r.doc_id: r for r in M.mix(d).collect()}
    count = defaultdict(int)
    for r in M.mixed_documents(d).collect():
        count[r.doc_id] += 1
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    words, goal = defaultdict(int), {}
    for i, c in count.items():
        words[source[i]] += c * size[i]
        assert c <= 2
    for i, r in want.items():
        goal[source[i]] = r.target
    assert all(abs(words[s] - g) <= max(size[i] for i in size if source[i] == s) for s, g in goal.items())
