"""Sharding by histogram sort: shards of near equal bytes, equal texts side by side.

Rows are ordered by a key of 24 bytes: the hash of the text, the hash of the id, and the row's place in its input
partition, which tells repeated rows apart. Borders between shards are found by counting: in each round every task
counts the exact bytes and rows between candidate borders, and the next candidates go where a border is still open,
until each lies within its tolerance or between two rows. Only then do the rows move, once, to their places.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import fresh_path, materialize, scratch

#: Bytes of a key, and of the part that equal texts share.
KEY, SHARED = 24, 8
#: Candidate borders in a round, at least four for each border that is still open.
PROBES = 1024
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: A shard is exchanged in pieces of about so many bytes, four at least, so that no task holds a whole shard.
PIECE_BYTES, LEAST_PIECES = 32 << 20, 4
#: How far a border may lie from its place, as a share of a shard; borders between pieces may be off by a share of a piece.
SHARD_TOLERANCE, PIECE_TOLERANCE = 0.01, 0.25


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none if null) and ROW_BYTES."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def row_key(id_col: Column, text: Column) -> Column:
    """The binary key of a row: hash of the text, hash of the id, place of the row."""
    parts = [F.xxhash64(text), F.xxhash64(id_col), F.monotonically_increasing_id()]
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in parts]))


@dataclass(frozen=True)
class Border:
    """Where a border is wanted: this many bytes below it, give or take `slack`."""

    bytes: float
    slack: float


@dataclass(frozen=True)
class Gap:
    """What lies between two neighbouring candidates: bytes and rows, those below them, least and highest key."""

    below: int
    bytes: int
    rows: int
    least: int
    highest: int


def histogram(keys: DataFrame, probes: list[int]) -> list[Gap]:
    """The gaps between the candidates that hold rows, in order; `keys` has key and size.

    Each task sorts a batch of keys and adds up what falls between candidates; a row a task and gap is shuffled.
    """
    bounds = [p.to_bytes(KEY, "big") for p in probes]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = f"S{KEY}"
        edges, n = np.frombuffer(b"".join(bounds), kind), len(bounds) + 1
        sums, rows, least, highest = np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n, [b""] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = b"".join(batch.column(0).to_pylist())
            placed = np.frombuffer(whole, kind)
            order = np.argsort(placed, kind="stable")
            placed, sizes = placed[order], batch.column(1).to_numpy()[order]
            starts = np.concatenate([[0], np.searchsorted(placed, edges, "left"), [len(placed)]])
            before = np.concatenate([[0], np.cumsum(sizes)])
            sums += before[starts[1:]] - before[starts[:-1]]
            rows += np.diff(starts)
            for i in np.flatnonzero(np.diff(starts)):
                low, high = (whole[KEY * order[j] : KEY * order[j] + KEY] for j in (starts[i], starts[i + 1] - 1))
                least[i], highest[i] = min(least[i] or low, low), max(highest[i], high)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(sums[full]), pa.array(rows[full]), pa.array([least[i] for i in full], pa.binary()), pa.array([highest[i] for i in full], pa.binary())],
            ["gap", "bytes", "rows", "least", "highest"],
        )

    counted = keys.select("key", "size").mapInArrow(run, "gap int, bytes long, rows long, least binary, highest binary")
    met = counted.groupBy("gap").agg(F.sum("bytes"), F.sum("rows"), F.min("least"), F.max("highest")).orderBy("gap").collect()
    gaps, below = [], 0
    for _, size, rows, least, highest in met:
        gaps.append(Gap(below, size, rows, int.from_bytes(least, "big"), int.from_bytes(highest, "big")))
        below += size
    return gaps


def settle(border: Border, gap: Gap) -> int | None:
    """The border if it may lie at either end of the gap, or if nothing can part the gap's rows; None while it's open."""
    to_low, to_high = abs(gap.below - border.bytes), abs(gap.below + gap.bytes - border.bytes)
    if min(to_low, to_high) <= border.slack or gap.rows == 1 or gap.least == gap.highest:
        return gap.least if to_low <= to_high else gap.highest + 1
    return None


def candidates(gap: Gap, n: int) -> list[int]:
    """The gap's own ends and n keys spread evenly between its rows; between texts as long as it holds more than one."""
    unit = 1 << 8 * (KEY - SHARED)
    low, high = gap.least, gap.highest
    if low // unit == high // unit:
        unit = 1
    low, high = low // unit, high // unit
    return sorted({gap.least, gap.highest + 1} | {(low + max(1, (high - low) * i // n)) * unit for i in range(1, n + 1)})


def borders(keys: DataFrame, wanted: list[Border], probes: int = PROBES) -> list[int]:
    """Keys such that the bytes below each are as wanted, within its slack or to the nearest row.

    A border lies between two texts if one of these places is near enough, else inside a group of equal texts. The
    driver holds the candidates of one round. An empty table has all borders at 0.
    """
    gaps = histogram(keys, [])
    if not gaps:
        return [0] * len(wanted)
    found: dict[int, int] = {}
    while True:
        edges = [g.below for g in gaps]
        still: dict[Gap, int] = {}
        for i, border in enumerate(wanted):
            if i not in found:
                gap = gaps[max(0, bisect_right(edges, border.bytes) - 1)]
                place = settle(border, gap)
                if place is None:
                    still[gap] = still.get(gap, 0) + 1
                else:
                    found[i] = place
        if not still:
            return [found[i] for i in range(len(wanted))]
        share = max(4, probes // sum(still.values()))
        gaps = histogram(keys, sorted({key for gap, n in still.items() for key in candidates(gap, share * n)}))


def place_among(limits: list[int]):
    """A function from a column of keys to the number of limits at or below each."""
    packed = b"".join(x.to_bytes(KEY + 1, "big") for x in sorted(limits))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        ends = np.frombuffer(packed, f"S{KEY + 1}")
        held = np.frombuffer(b"".join(b"\0" + k for k in keys), f"S{KEY + 1}")
        return pd.Series(np.searchsorted(ends, held, "right").astype(np.int32))

    return place


def write_shards(df: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = PIECE_BYTES, tolerance: float = SHARD_TOLERANCE) -> None:
    """Write all rows into `shards` folders of near equal bytes below path/rows, and a manifest of their pieces.

    A border between shards is at most `tolerance` of a shard from its place, or as near as whole rows allow, so a row that
    is larger than that makes its shard larger. Equal texts are in one shard if the tolerance allows, else in
    neighbouring ones. Null texts are a text of their own, without bytes; ids may be null or repeat; repeated rows
    all stay, told apart by their place in the input; shards may be empty if rows are few. Whole rows are kept in the
    column doc, whatever the names of their columns. The same input gives the same shards.
    """
    text, spark = F.col(text_col), df.sparkSession
    with scratch(spark):
        keys = materialize(df.select(row_key(F.col(id_col), text).alias("key"), row_size(text).alias("size")), "shard-keys")
        total = keys.agg(F.sum("size")).first()[0] or 0
        shard = total / shards
        pieces = max(LEAST_PIECES, -(-total // (shards * piece_bytes)))
        outer = [Border(shard * i, shard * tolerance) for i in range(1, shards)]
        inner = [Border(shard * (i + j / pieces), shard / pieces * PIECE_TOLERANCE) for i in range(shards) for j in range(1, pieces)]
        limits = borders(keys, outer + inner)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    measured = df.select(row.alias("doc"), row_key(F.col(id_col), text).alias("key"), row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    placed = measured.withColumns({"shard": place_among(limits[: shards - 1])("key"), "piece": place_among(limits)("key")})
    # The one exchange of the rows: by piece, in order of their keys.
    ordered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "piece").orderBy("key")))
    ordered.drop("key").write.partitionBy("shard").parquet(f"{path}/rows")
    rows = _rows(spark, path, df)
    sizes = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("first_slot", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/manifest")


def _rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = StructType().add("doc", like.schema).add("size", "long").add("text_crc32", "long").add("piece", "integer").add("nth", "integer").add("shard", "integer")
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """(shard, slot, size, text_crc32, doc) of written shards; slots count from 0 in each. `like` has the columns of doc."""
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "piece", "first_slot")
    # One row a piece, which Spark broadcasts if it is small.
    return _rows(spark, path, like).join(manifest, ["shard", "piece"]).select("shard", (F.col("first_slot") + F.col("nth") - 1).alias("slot"), "size", "text_crc32", "doc")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, read back from the shards."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "shards")
    write_shards(docs, 40, path)
    found = read_shards(spark, path, docs)
    return found.select("doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
