"""From raw documents to mixed, tokenised training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read back as the next stage's documents. All but the last return the columns of
documents, extra ones and clashing names too. An empty table goes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import discard, materialize, scratch
from docloom.llm.decontaminate import drop_leaks
from docloom.llm.jaccard import keep_one_alike
from docloom.llm.mixing import mixed_documents
from docloom.llm.token_files import encode_and_read
from docloom.llm.toxicity import drop_toxic, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, doesn't reject.

    Null and empty texts stay; repeated rows share their fate; null ids have no label and are judged as any other.
    """
    return drop_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of 0.8 or more over five-word shingles.

    The one with the smallest id stays, null last; of rows equal in id and text one. Null, empty and
    blank texts are one group.
    """
    return keep_one_alike(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its budget of edits.

    Null and empty texts stay, as items without words match nothing; ids aren't looked at, repeated rows share their fate.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, copies as rows of their own.

    A null source is a source. Rows equal in id, source and text are one document of their joint size.
    Documents without words (null, empty or blank texts) stay once.
    """
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files: place, length and checksum of each document, read back from them.

    Null and empty texts hold the end id alone; null ids come first; each copy is a document.
    """
    return encode_and_read(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: The toxicity model is fitted iteratively, and the mix draws at random: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table. A stage's own tables go when its output is
    written, and that when the next one's is; the last stage writes its files before it returns."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True, instead_of=last)
        last = docs
    found = STAGES[-1][1](spark, docs, sf_dir)
    discard(last)
    return found
