"""Operators that make rows or sections out of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, sentence), one row a sentence. Narrow."""
    return df.select(F.col(id_col), F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sentence"))


def halves(text: Column) -> Column:
    """Struct of section1 and section2: the first n // 2 sentences and the rest, joined by spaces."""

    def cut(s: Column) -> Column:
        half = F.floor(F.size(s) / 2).cast("int")
        return F.struct(F.array_join(F.slice(s, F.lit(1), half), " ").alias("section1"), F.array_join(F.slice(s, half + 1, F.size(s)), " ").alias("section2"))

    return T.once(T.sentences(text), cut)


def policy_sections(text: Column) -> Column:
    """Struct of section1 and section2: of the parts between blank lines that hold a policy word, the
    first and the rest joined by line breaks; with fewer than two such parts, the halves."""
    wanted = F.filter(F.split(text, "\n\n"), lambda p: contains_any(F.lower(p), R.POLICY_WORDS))

    def pick(p: Column) -> Column:
        own = F.struct(F.get(p, F.lit(0)).alias("section1"), F.array_join(F.slice(p, F.lit(2), F.size(p)), "\n").alias("section2"))
        return F.when(F.size(p) >= 2, own).otherwise(halves(text))

    return T.once(wanted, pick)


def contains_any(lower: Column, words: list[str], whole_word: bool = False) -> Column:
    """True if any of the words is in the lower-cased text, as a substring or as whole words. The tests
    form a balanced tree, so many words don't nest deeply."""
    import re

    if whole_word:
        return lower.rlike(T.UNICODE + r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b")
    tests = [lower.contains(w) for w in words] or [F.lit(False)]
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def split_halves(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section1, section2) by sentence count. Narrow."""
    return df.select(id_col, halves(F.col(text_col)).alias("s")).select(id_col, "s.*")


def split_policy_sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section1, section2) by policy words. Narrow."""
    return df.select(id_col, policy_sections(F.col(text_col)).alias("s")).select(id_col, "s.*")


def split_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, paragraph): parts between blank lines, trimmed, without empty ones. Narrow."""
    parts = F.filter(F.transform(F.split(F.col(text_col), "\n\n"), T.strip), lambda p: p != "")
    return df.select(id_col, F.posexplode(parts).alias("pos", "paragraph"))
