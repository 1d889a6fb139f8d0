"""Matching and score against a plain search for every entry, and what the folding undoes."""

import math
import random

import pytest

from docloom.llm import toxicity as X


def plain(weights, exceptions, text):
    """Words one by one: the heaviest entry that is the word or its beginning, unless it stands in an exception."""
    folded = X.fold(text)
    spared = set()
    for phrase in exceptions:
        p, at = X.fold(phrase), -1
        while (at := folded.find(p, at + 1)) >= 0:
            spared.update(range(at, at + len(p) - 1))  # the space behind it begins the next word
    best, at = [], 0
    for word in folded.split():
        at = folded.index(" " + word, at)
        fits = [w for e, w in weights.items() if (e.endswith(" ") and e.strip() == word) or (not e.endswith(" ") and word.startswith(e.strip()))]
        if fits and at not in spared:
            best.append(max(fits))
        at += len(word)
    return sum(best), max(best, default=0.0), len(folded.split())


def test_features_and_score_equal_a_plain_search():
    rng = random.Random(6)
    words = ["clown", "clowns", "fish", "moron", "morose", "m0ron", "class", "a", "pig", "guinea", "p!g", "iron", "stup1d", "stupid", "x.y", "id.iot", "trash", "can", "white"]
    weights = {" clown ": 3.0, " clow": 1.0, " moro": 2.0, " moron ": 5.0, " pig ": 1.5, " stupid": 2.5, " idiot ": 4.0, " trash ": 2.0}
    exceptions = ["clown fish", "class clown", "guinea pig", "white trash can", "trash can"]
    lex = X.Lexicon(weights, exceptions)
    model = X.ToxicityModel(weights, exceptions, (-2.0, 1.5, 0.5, 0.25))
    for _ in range(1500):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        total, highest, n = lex.features(text)
        want = plain(weights, exceptions, text)
        assert (total, highest, n) == pytest.approx(want), text
        z = -2.0 + 1.5 * total / math.sqrt(n + 25.0) + 0.5 * math.log1p(total) + 0.25 * highest
        assert X.score(model, total, highest, n) == pytest.approx(1 / (1 + math.exp(-z)))


def test_padding_accents_and_marks_hide_nothing():
    assert X.fold("1d10t" + "s" * 60).strip() == "idiot" + "s" * 60
    assert X.fold("idíot") == " idiot " and X.fold("ÍDÏOT") == " idiot "
    assert "idiot" in X.fold("id.iot").split() and "idiot" in X.fold("you i-d-i-o-t!").split()
    assert X.fold("end.Next well-known") == " end next well known "


def test_many_exceptions_take_linear_time():
    import time

    lex = X.Lexicon({" clown ": 3.0}, ["clown fish"])
    began = time.process_time()
    assert lex.features("clown fish " * 100_000)[0] == 0 and lex.features("clown x " * 100_000)[0] == 300_000.0
    assert time.process_time() - began < 10


def test_no_id_fills_the_sample(spark):
    rows = [(1, f"you are a moron number {i}") for i in range(600)] + [(1, "the very same row")] * 300 + [(i, f"fine day {i}") for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 400)] + [(7, 1), (1, 1)], "doc_id long, toxic int")
    seen = []
    real = X.with_features
    try:
        X.with_features = lambda r, m, c: seen.append(r.count()) or real(r, m, c)
        a = X.learn(docs, labels, train_rows=200)
    finally:
        X.with_features = real
    assert 80 < seen[0] < 400 and X.learn(docs, labels, train_rows=200).coefficients == a.coefficients
