"""Document ingest where uploads keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import ingest_columns
from ..sources.documents import stored_form


def read_uploads(spark: SparkSession, path: str, schema: str = "doc_id long, filename string, text string, uploaded_at timestamp", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of uploads from Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_stream(stream: DataFrame, delay: str = "1 hour", id_col: str = "doc_id", time_col: str = "uploaded_at", mode: str = "structured") -> DataFrame:
    """Cleaned documents in the form of the store, the first upload of an id within the delay only.
    State is one id for each upload of that span, and is dropped with the watermark."""
    once = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])
    return stored_form(ingest_columns(once, id_col, mode=mode), F.col("id"))


def start_ingest(stream: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append to the store; the file sink's log and the checkpoint make each document arrive exactly once."""
    return ingest_stream(stream, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
