"""Shingle sets at a Jaccard similarity of 0.8 against a comparison of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as P
from docloom.llm import jaccard

WORDS = [f"w{i}" for i in range(300)]


def plain_kept(rows):
    def shingles(t):
        w = t.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def corpus():
    rng, texts = random.Random(3), []
    for n in (12, 40, 120, 400):
        for _ in range(6):
            base = [rng.choice(WORDS) for _ in range(n)]
            texts.append(base)
            for k in (1, 1, 2, 3, 5, 8, 12):
                near = list(base)
                for at in rng.sample(range(n), min(k, n // 4)):
                    near[at] = rng.choice(WORDS)
                texts.append(near)
    return [(i, " ".join(t)) for i, t in enumerate([*texts, [], ["a"], ["A"]])]


def test_near_dedup_takes_all_at_the_limit(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_dedup(spark, d, "").collect()) == plain_kept(rows)


def test_band_that_everyone_shares_is_spread_over_tasks(spark):
    d = spark.range(3000).selectExpr("id AS fp", "pmod(hash(id), 500) AS rank", "100L AS size", "array(7L, 1000 + id) AS keys").repartition(5)
    pairs = {(r.a, r.b) for r in jaccard.neighbours(d).collect()}
    assert all(a < b for a, b in pairs) and len(pairs) <= 2 * 3000
    up = list(range(3000))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert len({find(i) for i in range(3000)}) == 1


def templated(seed):
    """Texts of a few templates with slots: most pairs of one template are somewhat below or above 0.8."""
    rng, texts = random.Random(seed), []
    for n, count in ((60, 60), (150, 80), (300, 60)):
        base = [rng.choice(WORDS) for _ in range(n)]
        for _ in range(count):
            near = list(base)
            for at in rng.sample(range(n), rng.randint(1, max(2, n // 40))):
                near[at] = rng.choice(WORDS)
            texts.append(near)
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, " ".join(texts[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("exact", [False, True])
def test_templates_are_grouped_as_by_all_pairs(spark, seed, exact):
    rows = templated(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one_alike(d, exact=exact).collect()) == plain_kept(rows)


@pytest.mark.parametrize("exact", [False, True])
def test_groups_of_several_parts(spark, exact, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 30 * (jaccard.SET + 200))
    rows = templated(3)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one_alike(d, exact=exact).collect()) == plain_kept(rows)


def test_links_that_first_candidates_miss(spark):
    """Sets in a chain share one key; in Gray order each stands beside sets that it isn't like."""
    sets = [list(range(5 * i, 5 * i + 100)) for i in range(40)]
    ranks = [(i * 17) % 40 for i in range(40)]
    d = spark.createDataFrame([(i, 100, ranks[i], [7]) for i in range(40)], "fp long, size long, rank long, keys array<long>")
    hashes = spark.createDataFrame(list(enumerate(sets)), "sid long, hashes array<long>")
    near, members = jaccard._met(d)

    def alike(a, b):
        return 9 * len(set(sets[a]) & set(sets[b])) >= 4 * 200

    verified = spark.createDataFrame([(r.a, r.b) for r in near.collect() if alike(r.a, r.b)], "a long, b long")
    found = [(r.a, r.b) for r in verified.union(jaccard._between(members, verified, d, hashes, False)).collect()]
    assert all(alike(a, b) for a, b in found)
    up = list(range(40))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert len({find(i) for i in range(40)}) == 1


def test_overlaps_and_prefixes():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, 3)) for _ in range(3)]
    pool = rng.integers(-(2**63), 2**63 - 1, 9000)
    sets += [np.unique(rng.choice(pool, n)) for n in (1, 10, 500, 6000, 8000)]
    assert jaccard.overlaps(sets, sets).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    base = np.unique(rng.integers(0, 2**64 - 1, 90, dtype=np.uint64))
    near = [np.unique(np.concatenate([np.delete(base, rng.choice(len(base), 5, replace=False)), rng.integers(0, 2**64 - 1, 4, dtype=np.uint64)])) for _ in range(40)]
    for a, b in combinations(near, 2):
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert set(jaccard.prefix(a)) & set(jaccard.prefix(b))
    assert jaccard.prefix(base[:0]) == [] and len(jaccard.prefix(base[:1])) == 1


def test_stated_recall():
    assert 1 - jaccard.recall(0.8) < 1 / 2700 and jaccard.recall(0.9) > 1 - 1e-6
