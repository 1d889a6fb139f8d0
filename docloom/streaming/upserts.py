"""A store in which later versions of a document replace earlier ones, fed by a stream in batches that may be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import ingest_columns
from ..sources.documents import STORE, stored_form

#: The store's columns, the version of a row, and the batch that brought it, which is a folder.
VERSIONED = STORE + ", version timestamp, batch long"


def merge_batch(path: str, id_col: str = "doc_id", time_col: str = "uploaded_at", mode: str = "structured") -> Callable[[DataFrame, int], None]:
    """What foreachBatch does with uploads: clean the latest version of each id in the batch and write it to the batch's own folder.

    A batch that is run again, after a failure at any place, replaces its folder, so nothing is there twice; readers
    see a folder's files only when the whole batch is done. Of equal times the greater (filename, text) counts; a null time is the earliest.
    Rows without id are one document.
    """

    def merge(uploads: DataFrame, batch: int) -> None:
        newest = F.max(F.struct(F.col(time_col).alias("version"), "filename", "text")).alias("u")
        latest = uploads.groupBy(id_col).agg(newest).select(id_col, "u.*")
        stored_form(ingest_columns(latest, id_col, mode=mode, kept=["version"]), F.col("id"), kept=["version"]).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return merge


def start_upserts(stream: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Take what has arrived into the store; the checkpoint gives a batch the same number and rows whenever it is run."""
    return stream.writeStream.foreachBatch(merge_batch(path, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions that the store has, with version and batch."""
    return spark.read.schema(VERSIONED).parquet(path)


def _latest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("id").agg(F.max(F.struct("version", "batch")).alias("l")).select(F.col("id").alias("__i"), F.col("l.version").alias("__v"), F.col("l.batch").alias("__b"))
    on = F.col("id").eqNullSafe(F.col("__i")) & F.col("version").eqNullSafe(F.col("__v")) & (F.col("batch") == F.col("__b"))
    return rows.join(last, on, "left_semi").drop("batch")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each document in the form of the store; of equal versions that of the latest batch.

    Which one that is comes from ids, versions and batches alone, added up map-side; then a join by these three,
    which are together unique, finds the rows that stay.
    """
    return _latest(read_versions(spark, path)).drop("version")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the latest versions, one row a document, as the first batch of a new store; for use while no stream writes.

    The stream goes on with the new path and its old checkpoint.
    """
    _latest(read_versions(spark, path)).write.parquet(f"{into}/batch=-1")
