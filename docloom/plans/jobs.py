"""Composite jobs over a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, compare, entities, explode, recommend, stats
from ..sources import documents as docs

#: Least words of a summary, of texts that have so many.
LEAST_WORDS = 40


def preprocess_job(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, statistics) of documents with any text. Narrow."""
    def row(t: Column) -> Column:
        words, ends = stats.word_count(t), stats.sentence_count(t)
        record = F.struct(words.alias("word_count"), ends.alias("sentence_count"), F.round(words / F.greatest(ends, F.lit(1)), 2).alias("average_words_per_sentence"))
        return F.struct(t.alias("text"), record.alias("statistics"))

    return df.filter(T.non_empty(F.col(text_col))).select(id_col, F.inline(F.transform(F.array(T.preprocess_text(F.col(text_col))), row)))


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) preprocessed and then sanitised."""
    return df.select(id_col, T.sanitize_text(T.preprocess_text(F.col(text_col))).alias("text"))


def full_analysis(df: DataFrame, gazetteer: DataFrame, hist: DataFrame, query: DataFrame, id_col: str = "doc_id", text_col: str = "text", cat_cols=("location", "month"), num_cols=("temperature_c", "humidity_pct", "wind_kmh"), label_col: str = "condition", max_input: int | None = 4000) -> DataFrame:
    """One record a document: section comparison, summaries of both sections (of their first max_input characters;
    None: all), entities, and the recommendation for one fixed query (one row of `query`)."""
    text = cleaned(df, id_col, text_col)
    sections = explode.split_policy_sections(text, id_col)
    compared = compare.section_similarity(text, id_col)
    summaries = sections.select(id_col, entities.summary_column(F.col("section1"), max_input, min_words=LEAST_WORDS).alias("summary1"), entities.summary_column(F.col("section2"), max_input, min_words=LEAST_WORDS).alias("summary2"))
    found = entities.extract_entities(text, gazetteer, id_col, offsets=True)
    named = found.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "label", "text"))), lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"))).alias("entities"))
    advice = recommend.recommend(query, hist, list(cat_cols), list(num_cols), label_col).select(F.struct("predicted", "confidence", "top", "message").alias("recommendation"))
    full = compared.join(summaries, id_col).join(named, id_col, "left")
    # One row: the fixed query's recommendation.
    return full.crossJoin(F.broadcast(advice.limit(1)))


def policy_report(df: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_input: int | None = 4000) -> DataFrame:
    """(id, twelve lists, summary, word_count, entities) of raw texts; the summary reads max_input characters, None: all."""
    text = F.col(text_col)
    tagged = classify.policy_analysis(df, id_col, text_col)
    plain = df.select(id_col, entities.summary_column(text, max_input, min_words=LEAST_WORDS).alias("summary"), stats.word_count(text).alias("word_count"))
    named = _entity_lists(entities.extract_entities(df, gazetteer, id_col, text_col, offsets=True), id_col)
    return tagged.join(plain, id_col).join(named, id_col, "left")


def _entity_lists(found: DataFrame, id_col: str) -> DataFrame:
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("start", "label", "text"))), lambda e: F.concat(e["label"], F.lit(":"), e["text"]))
    return found.groupBy(id_col).agg(F.array_join(pairs, "|").alias("entities"))


def text_report(df: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word_count, sentence_count, entities, phrases)."""
    plain = df.select(id_col, stats.nonpunct_word_count(F.col(text_col)).alias("word_count"), stats.model_sentence_count(F.col(text_col)).alias("sentence_count"))
    named = _entity_lists(entities.extract_entities(df, gazetteer, id_col, text_col, offsets=True), id_col)
    phrases = entities.key_phrases(df, id_col, text_col).groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list("phrase")), "|").alias("phrases"))
    return plain.join(named, id_col, "left").join(phrases, id_col, "left")


def ner_job(df: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entities of the preprocessed and sanitised texts."""
    return entities.extract_entities(cleaned(df, id_col, text_col), gazetteer, id_col)


def summarize_job(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_input: int | None = 4000) -> DataFrame:
    """Summaries of the preprocessed and sanitised texts, of their first max_input characters; None: all."""
    return entities.summarize(cleaned(df, id_col, text_col), id_col, max_input=max_input, min_words=LEAST_WORDS)


def ingest_columns(df: DataFrame, id_col: str = "doc_id", name_col: str = "filename", text_col: str = "text", mode: str = "structured", kept: Sequence[str] = ()) -> DataFrame:
    """(id, filename, original_text, processed_text, original_length, processed_length, preview) and the columns `kept`:
    stateless, for batches and streams alike."""
    done = df.select(*kept, F.col(id_col).alias("id"), F.col(name_col).alias("filename"), F.coalesce(F.col(text_col), F.lit("")).alias("original_text"))
    done = done.withColumn("processed_text", T.clean_document(F.col("original_text"), mode))
    return done.select("*", F.length("original_text").alias("original_length"), F.length("processed_text").alias("processed_length"), T.preview_chars(F.col("processed_text")).alias("preview"))


def ingest_job(df: DataFrame, path: str, id_col: str = "doc_id", name_col: str = "filename", text_col: str = "text", mode: str = "structured") -> None:
    """Clean documents and append them to the store."""
    done = ingest_columns(df, id_col, name_col, text_col, mode)
    docs.store_documents(done, path, F.col("id"))
