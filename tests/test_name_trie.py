"""Names of any number of words by the trie, against plain search, and their cost."""

import random
import re
import time

import pytest
from docloom.operators import entities

TOKEN = re.compile(r"[^\W_]+")


def plain(rows, names):
    """Names whose words and what stands between them are in the text, beginning and ending with whole words."""
    keys = {}
    for name, label in names:
        words = list(TOKEN.finditer((name or "").lower()))
        if words:
            key = name.lower()[words[0].start() : words[-1].end()]
            keys[key] = min(keys.get(key, label), label)
    sizes = {k: len(TOKEN.findall(k)) for k in keys}
    out = []
    for i, text in rows:
        words = list(TOKEN.finditer(text or ""))
        for a in range(len(words)):
            for n in set(sizes.values()):
                if a + n <= len(words):
                    found = text[words[a].start() : words[a + n - 1].end()]
                    if found.lower() in keys:
                        out.append((i, found, keys[found.lower()], words[a].start(), words[a + n - 1].end()))
    return sorted(out, key=str)


@pytest.mark.parametrize("longest", [1, 3, 4, 5, 8, 9, 30])
def test_as_plain_search(spark, longest):
    rng = random.Random(longest)
    words, gaps = ["ab", "Cd", "ef", "ä1"], [" ", " ", "-", ", "]

    def phrase(n):
        return "".join(w + g for w, g in zip([rng.choice(words) for _ in range(n)], [rng.choice(gaps) for _ in range(n)], strict=True)).rstrip(" ,-")

    names = [(phrase(rng.randrange(1, longest + 1)), rng.choice("XYZ")) for _ in range(40)] + [("...", "X"), ("", "X"), (None, "X")]
    rows = [(i, phrase(rng.randrange(60)) + rng.choice(["", ".", " " + rng.choice(names[:40])[0] + "!"])) for i in range(30)] + [(30, None), (31, ""), (None, names[0][0])]
    rows += [rows[0], (rows[0][0], rows[1][1])]
    got = entities.name_entities(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(names, "name string, label string")).collect()
    want = plain(rows, names)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 5


def test_no_names_and_no_texts(spark):
    df, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "name string, label string")
    assert entities.name_entities(df, none).collect() == []
    assert entities.name_entities(df.limit(0), spark.createDataFrame([("a b c d e f", "X")], "name string, label string")).collect() == []


def test_a_long_name_costs_its_own_hits(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    text = " ".join(rng.choice(words) for _ in range(60_000))
    df = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").repartition(4).cache()
    df.count()
    long = " ".join(text.split()[1000:1200])

    def took(names):
        gaz = spark.createDataFrame([(n, "X") for n in names], "name string, label string")
        times = []
        for _ in range(3):
            began = time.time()
            n = entities.name_entities(df, gaz).count()
            times.append(time.time() - began)
        return min(times), n

    short, n = took([" ".join(text.split()[1000:1002])])
    far, m = took([long, *[f"{words[i]} {words[i + 1]} and more words that never come" for i in range(100)]])
    assert n >= 4 and m == 4
    assert far < 1.2 * short + 3  # 3 s: the jobs of the second look, which do not grow with the text


def test_trie_shares_prefixes(spark):
    names = spark.createDataFrame([("New York City", "X"), ("new york", "Y"), ("New Jersey", "X")], "name string, label string")
    trie = entities.name_trie(names).collect()
    assert sorted((r.piece, r.label, r.more, r.words) for r in trie) == [(" city", "X", False, 3), (" jersey", "X", False, 2), (" york", "Y", True, 3), ("new", None, True, 3)]
