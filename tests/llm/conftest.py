import random

import pytest

#: Columns that operators themselves make, to see that a table's own don't get in the way.
CLASH = ["n_tokens", "size", "target", "fp", "id", "bucket", "score", "words", "start", "item_id", "digest", "part"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(rng.choice(words) for _ in range(60_000))
    near = " ".join(rng.choice(words) for _ in range(400))
    rows = [
        (1, "one two three four five six", "en", "a"),
        (2, "one two three four five six", "en", "b"),
        (2, "one two three four five six", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \n\t\x0b ", "de", "b"),
        (None, "no id here at all", "fr", "a"),
        (None, None, None, None),
        (6, long, "en", "a"),
        (7, near, "en", "c"),
        (8, near + " kappa", "en", "c"),
        (9, "naïve 世界 😀 <|endoftext|> it's  fine\r\n", "es", "é"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        d = d.selectExpr("*", f"'x' AS {c}")
    return d


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
