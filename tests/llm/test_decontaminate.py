"""Edit matching against a plain edit distance."""

import random

from docloom.llm import decontaminate as D


def plain_distance(pattern, window):
    last = list(range(len(pattern) + 1))
    best = last[-1]
    for w in window:
        now = [0]
        for i, p in enumerate(pattern, 1):
            now.append(min(last[i - 1] + (p != w), last[i] + 1, now[-1] + 1))
        last, best = now, min(best, now[-1])
    return best


def test_finds_what_edit_distance_finds():
    rng = random.Random(3)
    for _ in range(1500):
        items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 14)))) for i in range(4)]
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                if part:
                    at, kind = rng.randrange(len(part)), rng.random()
                    part[at : at + (kind < 0.7)] = [] if 0.4 < kind < 0.7 else [rng.choice("abz")]
            words[7:7] = part
        got = {n: d for n, d, *_ in D.Matcher(items, 0.2).find(" ".join(words))}
        wanted = {n: d for n, t in items if (p := t.split()) and (d := plain_distance(p, words)) <= int(len(p) * 0.2)}
        assert got == wanted


def test_long_item_and_long_text():
    rng = random.Random(1)
    item = [f"w{rng.randrange(500)}" for _ in range(400)]
    text = [f"w{rng.randrange(500)}" for _ in range(20_000)]
    text[9000:9000] = item[:100] + ["x"] * 20 + item[100:]
    ((number, distance, budget, start, m),) = D.Matcher([(7, " ".join(item))], 0.2).find(" ".join(text))
    assert (number, distance, budget, m) == (7, 20, 80, 400) and abs(start - 9020) <= 20


def test_tables(spark, awkward, nothing):
    items = spark.createDataFrame([(10, "One two, THREE four five seven"), (11, None), (12, "!!"), (12, "no id here at all"), (13, "No id here at all."), (None, "one two three four five six")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in D.find_leaks(awkward, items).collect()}
    assert got == {(1, 10, 1), (2, 10, 1), (1, None, 0), (2, None, 0), (None, 12, 0), (None, 13, 0)}
    assert D.find_leaks(awkward, items).count() == 8  # the repeated row counts twice
    clean = D.drop_leaks(awkward, items)
    assert clean.columns == awkward.columns and clean.count() == awkward.count() - 4
    assert D.find_leaks(nothing, items).count() == 0 and D.find_leaks(awkward, items.limit(0)).count() == 0
    assert D.drop_leaks(awkward, items.limit(0)).count() == awkward.count()


def test_blocks_agree(spark, awkward):
    items = spark.createDataFrame([(str(i), f"one two three four five {i}") for i in range(20)], "item_id string, text string")
    whole = sorted(map(tuple, D.find_leaks(awkward, items).collect()))
    assert sorted(map(tuple, D.find_leaks(awkward, items, block_bytes=60).collect())) == whole and len(whole) == 60


def test_scripts_without_spaces():
    zh = "深度学习模型在大规模语料上进行预训练然后微调"
    ja = "これはベンチマークの問題文です"
    m = D.Matcher([(1, zh), (2, ja), (3, "短い"), (4, "plain words here")], 0.2)
    got = {n: d for n, d, *_ in m.find("前面的文字" + zh[:5] + "好" + zh[6:] + "后面的文字。" + "前" + ja + "後")}
    assert got == {1: 1, 2: 0}
    assert m.find("some plain words here") == [(4, 0, 0, 1, 3)]


def test_a_block_near_its_bound_stays_small():
    import random
    import tracemalloc

    rng = random.Random(2)
    words = [f"w{i}" for i in range(50_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(10_000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    m = D.Matcher(items, 0.2)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size > 3_000_000 and held < 12 * size
    assert [h[0] for h in m.find("x y " + items[77][1] + " z")] == [77]


def test_common_short_items_take_linear_time():
    import time

    m = D.Matcher([(1, "the"), (2, "of the")], 0.2)
    began = time.process_time()
    assert {n: d for n, d, *_ in m.find("of the " * 200_000)} == {1: 0, 2: 0}
    assert time.process_time() - began < 5
