"""Fingerprints, index and components against plain comparisons of all pairs."""

import random

import numpy as np
import xxhash

from docloom.llm import gray_index, simhash
from docloom.llm.components import connected_components
from docloom.llm.gray_index import gray_rank, link_all


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_labels(codes, limit):
    up = list(range(len(codes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (int(codes[i]) ^ int(codes[j])).bit_count() <= limit:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def clustered(rng, n, flips):
    c = rng.integers(0, 2**63, size=max(1, n // 8), dtype=np.uint64)[rng.integers(0, max(1, n // 8), n)]
    for _ in range(flips):
        c = c ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    c = np.unique(c)
    return c[np.argsort(gray_rank(c))]


def test_gray_rank_undoes_the_gray_code():
    x = np.arange(5000, dtype=np.uint64)
    assert gray_rank(x ^ (x >> np.uint64(1))).tolist() == x.tolist()


def test_index_finds_all_links(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(60):
        c = clustered(rng, int(rng.integers(1, 120)), trial % 6)
        for limit in (0, 2, 4, 7):
            assert link_all(c, limit).tolist() == plain_labels(c, limit)
    monkeypatch.setattr(gray_index, "HELD", 5)
    c = clustered(rng, 100, 3)
    assert link_all(c, 4).tolist() == plain_labels(c, 4)


def test_tables_miss_no_pair():
    rng = random.Random(2)
    for n in (10, 10**6, 10**8, 10**11):
        tables = [[((1 << bits) - 1) << at for at, bits in t] for t in simhash.banding(n, 4)]
        for _ in range(300):
            flipped = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not any(flipped & m for m in t) for t in tables)


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 50, 500):
        text = " ".join(rng.choice(["Ab", "c", "É", "dd"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_print(text)
    assert simhash.fingerprint(b" \t\x0b\n") == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 520)] + [(1000, i) for i in range(1001, 1200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, awkward, nothing):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(50)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 - i, " ".join(text)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    ids = sorted(i for i, _ in rows)
    prints = [plain_print(dict(rows)[i]) for i in ids]
    labels = plain_labels(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {i: (f"{p:016x}", ids[at]) for i, p, at in zip(ids, prints, labels, strict=True)}
    kept = sorted(r.doc_id for r in simhash.keep_one(d).collect())
    assert kept == sorted({ids[at] for at in labels})
    odd = simhash.near_duplicates(awkward).collect()
    assert len(odd) == awkward.count() and {r.component_id for r in odd if r.doc_id == 2} == {1}
    assert {r.component_id for r in odd if r.fingerprint == "0" * 16} == {3}
    one = simhash.keep_one(awkward)
    assert one.columns == awkward.columns and sorted(str(r.doc_id) for r in one.collect()) == sorted(map(str, {r.component_id for r in odd}))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_only_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "x")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(d).collect()} == {None, 4}
    assert simhash.keep_one(d).count() == 2


def test_large_group_of_copies_gives_few_links(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "concat('one two three four five six seven ', id % 3) AS text")
    r = simhash.near_duplicates(d).collect()
    assert len(r) == 3000 and len({x.component_id for x in r}) <= 3


def test_split_keys_miss_no_pair(spark):
    rng = np.random.default_rng(3)
    codes = clustered(rng, 400, 3)
    d = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    wanted = plain_labels(codes.tolist(), 4)
    for group in (8, 64, 1 << 15):
        found = connected_components(simhash.links(d, len(codes), 4, group)).collect()
        root = {r.node: r.root for r in found}
        got = [root.get(int(c), int(c)) for c in codes.view(np.int64)]
        assert len(set(zip(got, wanted, strict=True))) == len(set(got)) == len(set(wanted))


def test_dense_group_in_one_key(monkeypatch):
    rng = np.random.default_rng(4)
    c = np.full(600, 77, np.uint64)
    for _ in range(5):
        c = c ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    c = np.unique(c)
    c = c[np.argsort(gray_rank(c))]
    assert link_all(c, 4).tolist() == plain_labels(c, 4)


def test_null_id_is_no_string_id(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), ("null", "g h i j k l"), ("", "m n o p q r")], "doc_id string, text string")
    assert simhash.keep_one(d).count() == 3
