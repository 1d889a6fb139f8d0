"""Sentence categories by rules, and impact scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..scratch import materialize, scratch
from .automaton import BLOCK, TOGETHER, found_by, shards
from .explode import contains_any, split_sentences


def categories_of(sentence: Column, whole_word: bool = False) -> Column:
    """Array of the sentence's categories, in the order of the report."""
    lower = F.lower(sentence)
    tests = [F.when(contains_any(lower, R.CATEGORIES[c], whole_word) if c in R.CATEGORIES else sentence.rlike(R.TARGET_YEAR), F.lit(c)) for c in R.CATEGORY_ORDER]
    return F.filter(F.array(*tests), lambda c: c.isNotNull())


def classify_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_word: bool = False) -> DataFrame:
    """(id, category, pos, sentence), a row for each category of a sentence; expressions only, no join."""
    split = split_sentences(df, id_col, text_col)
    return split.select(id_col, F.explode(categories_of(F.col("sentence"), whole_word)).alias("category"), "pos", "sentence")


def classify_by_rules(df: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, blocks: int = TOGETHER) -> DataFrame:
    """(id, category, pos, sentence) by a table of (category, keyword): the keyword is in the lower-cased sentence.

    The rule table becomes automata of bounded size, which a sentence is walked through once, so its time doesn't
    grow with the keywords; a sentence is one row of each of its categories, and repeated rows of df stay. An automaton
    has at most `block` keywords, and `blocks` of them go to the tasks at once, TOGETHER at most; if there are more, the
    sentences pass through a table in between. Null
    keywords and categories match nothing; an empty keyword is in every sentence.
    """
    spark = df.sparkSession
    blocks = min(blocks, TOGETHER)
    sent = [spark.sparkContext.broadcast(shard) for shard in shards(rules, block)]
    rows = split_sentences(df, id_col, text_col).withColumn("__c", F.array().cast("array<string>"))
    with scratch(spark):
        for i in range(0, len(sent), blocks):
            rows = (materialize(rows, "classified") if i else rows).withColumn("__c", F.array_union("__c", found_by(sent[i : i + blocks], F.lower("sentence"))))
        found = rows.select(id_col, F.explode(F.array_sort("__c")).alias("category"), "pos", "sentence")
        return materialize(found, "classified", keep=True) if len(sent) > blocks else found


def policy_analysis(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one array of sentences for each of the twelve categories), in sentence order; narrow: each
    document is worked out by itself, so nothing is shuffled."""
    from ..functions.text import sentences

    tagged = F.transform(sentences(F.col(text_col)), lambda s: F.struct(s.alias("s"), categories_of(s).alias("c")))
    staged = df.select(id_col, F.coalesce(tagged, F.array()).alias("__t"))

    def listed(category: str) -> Column:
        return F.transform(F.filter("__t", lambda x: F.array_contains(x["c"], category)), lambda x: x["s"]).alias(category)

    return staged.select(id_col, *map(listed, R.CATEGORY_ORDER))


def category_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_word: bool = False) -> DataFrame:
    """(id, category, n): sentences of each category of a document; categories without any are left out.
    Counted inside the row, so there is no shuffle."""
    from ..functions.text import sentences

    found = F.transform(sentences(F.col(text_col)), lambda s: categories_of(s, whole_word))
    staged = df.select(id_col, F.flatten(found).alias("__c"))

    def counted(category: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.size(F.filter("__c", lambda x: x == category)).cast("long").alias("n"))

    return staged.select(id_col, F.inline(F.filter(F.array(*map(counted, R.CATEGORY_ORDER)), lambda x: x["n"] > 0)))


def category_totals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(category, n_documents, n_sentences) over the corpus; map-side sums of the counts in the rows."""
    return category_counts(df, id_col, text_col).groupBy("category").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_sentences"))


def impact(text: Column, kind: str) -> Column:
    """-1 to 1: words that raise less words that lower, over 3; 0 unless a word of the topic is there."""
    gate, more, less = R.IMPACTS[kind]
    lower = F.lower(text)
    points = sum((lower.contains(w).cast("int") for w in more), F.lit(0)) - sum((lower.contains(w).cast("int") for w in less), F.lit(0))
    return F.when(contains_any(lower, gate), F.greatest(F.least(points / F.lit(3.0), F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))


def climate_impacts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, temperature_impact, humidity_impact, wind_impact). Narrow."""
    return df.select(id_col, *[impact(F.col(text_col), k).alias(f"{k}_impact") for k in R.IMPACTS])
