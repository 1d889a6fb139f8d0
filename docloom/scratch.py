"""Tables between steps: written to the shared folder, read back, and deleted when nothing needs them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .session import fresh_path

#: Paths of the tables that materialize() wrote inside each open scratch() of this thread or context, outermost first.
#: Threads that run other queries have stacks of their own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("docloom_scratch", default=())


def materialize(df: DataFrame, name: str, keep: bool = False, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there.

    Unlike cached or locally checkpointed data the files outlive any executor. The table goes when
    the innermost scratch() ends, or, if it is to be kept, the one around that; `instead_of` is an earlier such table
    that nothing needs once this one is written: it goes at once.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    opened = _OPEN.get()
    if len(opened) > keep:
        opened[-1 - keep].append(path)
    if instead_of is not None:
        discard(instead_of)
    made = spark.read.schema(df.schema).parquet(path)
    made._docloom_path = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the files of a table of materialize()."""
    delete(df.sparkSession, df._docloom_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside and not kept are deleted at the end: what is made of them must be
    written, or have come to the driver, by then."""
    made: list[str] = []
    before = _OPEN.get()
    _OPEN.set((*before, made))
    try:
        yield
    finally:
        _OPEN.set(before)
        for path in made:
            delete(spark, path)
