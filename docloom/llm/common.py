"""Materialised tables, files in any store, and global ranks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import delete, discard, materialize, scratch  # noqa: F401
from ..session import fresh_path  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def hash_fraction(total: int, wanted: int) -> float:
    """The share of rows that gives about `wanted` of `total` rows, 1 at most."""
    return 1.0 if total <= wanted else wanted / total


def in_hash_sample(key: Column, share: float, salt: int = 17) -> Column:
    """True for about that share of keys; the same keys on every run."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def global_rank(df: DataFrame, by: Sequence[Column], out: str) -> DataFrame:
    """Add the 0-based rank of each row in the order of `by`, without a single-task sort.

    Rows are range-partitioned and numbered inside their partition; the partitions' sizes, one
    row each, give the offsets. Equal keys may fall in any order, but get different ranks; where many rows may be
    equal, `by` should end with something that tells them apart, so that they can be spread.
    """
    part, place = "__dl_part", "__dl_place"
    placed = materialize(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
        "ranked",
    )
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__dl_n"))
    before = F.sum("__dl_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(part), F.coalesce(before, F.lit(0)).alias("__dl_before"))
    # One row for each partition, so the broadcast is bounded by the number of tasks.
    return placed.join(F.broadcast(offsets), part).withColumn(out, F.col("__dl_before") + F.col(place)).drop(part, place, "__dl_before")


def filesystem(uri: str):
    """(file system, path) for a URI of any store that pyarrow knows, or for a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def open_output(uri: str):
    """An output stream; folders above it are made where the store has folders."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A file that can be read from any place."""
    store, path = filesystem(uri)
    return store.open_input_file(path)


def task_file(folder: str, suffix: str) -> tuple[int, str]:
    """(partition, file URI) for the running task. The name is new on every attempt, so a retried
    or speculative task never overwrites another's file; a manifest names those that count."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    return part, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"
