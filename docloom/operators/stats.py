"""Document and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def word_count(text: Column) -> Column:
    return F.size(T.tokenize_words(text))


def sentence_count(text: Column) -> Column:
    """Pieces between runs of . ! and ?, the one after the last run included."""
    return F.size(F.split(text, "[.!?]+", -1))


def nonpunct_word_count(text: Column) -> Column:
    """Words of letters and digits, with inner apostrophes and hyphens."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), F.lit(0)))


def model_sentence_count(text: Column) -> Column:
    """Sentences that aren't empty."""
    return F.size(F.filter(T.sentences(text), lambda s: T.strip(s) != ""))


def counts(text: Column) -> Column:
    """Struct of word_count and sentence_count of the preprocessed text, which is made once; null counts as empty."""
    return T.once(T.preprocess_text(F.coalesce(text, F.lit(""))), lambda t: F.struct(word_count(t).alias("word_count"), sentence_count(t).alias("sentence_count")))


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word_count, sentence_count, average_words_per_sentence) of the preprocessed text. Narrow."""

    def row(c: Column) -> Column:
        average = F.round(c["word_count"] / F.greatest(c["sentence_count"], F.lit(1)), 2)
        return F.struct(c["word_count"].alias("word_count"), c["sentence_count"].alias("sentence_count"), average.alias("average_words_per_sentence"))

    return df.select(id_col, F.inline(F.transform(F.array(counts(F.col(text_col))), row)))


def corpus_statistics(df: DataFrame, keys: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sums and averages of document_statistics() over every combination of the keys. Documents are summed
    by all keys first, so the combinations are made of few rows, not of all documents."""
    counted = df.select(*keys, counts(F.col(text_col)).alias("__c"))
    first = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("d"), F.sum("__c.word_count").alias("w"), F.sum("__c.sentence_count").alias("s"))
    return first.cube(*keys).agg(F.sum("d").alias("documents"), F.sum("w").alias("words"), F.sum("s").alias("sentences"), F.round(F.sum("w") / F.sum("d"), 6).alias("average_words"), F.grouping_id().alias("grouping"))


def display_metrics(similarity: Column, confidence: Column, average: Column) -> Column:
    """Struct of the similarity in whole percent, the confidence in percent and the average to one decimal."""
    return F.struct(F.round(similarity * 100, 0).alias("similarity_pct"), F.round(confidence * 100, 1).alias("confidence_pct"), F.round(average, 1).alias("average"))
