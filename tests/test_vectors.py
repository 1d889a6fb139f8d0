"""TF-IDF cosine of pairs: equal to brute force whether words' frequencies are sent or joined; rows sent are documents."""

import math
import random
from collections import Counter

import pytest

from docloom.operators import compare, vectors


def _rows():
    r = random.Random(8)
    made = [(i, " ".join(f"W{min(int(r.expovariate(0.05)), 90)}" for _ in range(r.randint(0, 40)))) for i in range(60)]
    # Repeated ids, null and blank texts.
    return [*made, (3, "w1 w2 only3"), (3, "only3"), (70, None), (71, "  "), (72, "once_a once_b"), (73, "once_b")]


def _brute(pairs):
    rows = [(i, Counter((t or "").lower().split())) for i, t in _rows()]
    df = Counter(w for _, c in rows for w in c)
    weights = {}
    for i, c in rows:
        own = weights.setdefault(i, Counter())
        for w, tf in c.items():
            own[w] += tf * (math.log((1 + len(rows)) / (1 + df[w])) + 1)

    def cosine(a, b):
        a, b = weights.get(a, {}), weights.get(b, {})
        norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return sum(v * b.get(w, 0) for w, v in a.items()) / norm if norm else 0.0

    return sorted((a, b, round(cosine(a, b), 9)) for a, b in pairs)


@pytest.mark.parametrize(("known", "at_once"), [(1 << 20, 1 << 21), (20, 50), (0, 1)])
def test_equal_brute_force(spark, monkeypatch, known, at_once):
    monkeypatch.setattr(vectors, "KNOWN", known)
    monkeypatch.setattr(vectors, "AT_ONCE", at_once)
    pairs = [(a, b) for a in (0, 1, 3, 5, 40, 70, 71, 72) for b in (*range(0, 60, 3), 70, 71, 72, 73, 999)] + [(1, 2), (1, 2)]
    d, asked = spark.createDataFrame(_rows(), "doc_id long, text string"), spark.createDataFrame(pairs, "id_a long, id_b long")
    got = sorted((r.id_a, r.id_b, round(r.similarity, 9)) for r in compare.text_similarity(d, asked).collect())
    want = _brute(pairs)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], abs=1e-8) for g, w in zip(got, want, strict=True))


def test_no_words_are_rows_of_pairs(spark, monkeypatch):
    seen = {}

    def noted(df, name, *more, real=vectors.materialize, **named):
        seen[name] = real(df, name, *more, **named)
        seen[name + " rows"] = seen[name].count()
        return seen[name]

    for module in (compare, vectors):
        monkeypatch.setattr(module, "materialize", noted)
    d = spark.createDataFrame([(i, " ".join(f"x{k}" for k in range(i, i + 50))) for i in range(6)], "doc_id long, text string")
    compare.text_similarity(d, spark.createDataFrame([(0, 1), (2, 5)], "id_a long, id_b long")).collect()
    assert all(n <= 6 for name, n in seen.items() if name.endswith(" rows") and name != "frequencies rows")
