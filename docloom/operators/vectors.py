"""TF-IDF cosine of pairs of documents. A document is one row of its words' hashes and counts, so that rows that are sent
are as many as documents and pairs, not as words; only words that aren't among the most frequent are rows of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import materialize

#: Words of which tasks are sent the frequencies, 12 bytes each, at most; frequencies of the others are joined.
KNOWN = 1 << 20
#: Words of pairs that are worked on at once.
AT_ONCE = 1 << 21


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """An array of n lists: the values of each row, which come in order."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _rows_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all elements."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(zero_copy_only=False)


def _summed(rows: np.ndarray, h: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, h, sum of values), sorted, once each."""
    order = np.lexsort((h, rows))
    rows, h, values = rows[order], h[order], values[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], h[at], np.add.reduceat(values, at) if len(at) else values


def word_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, tf), a row a document, as a table: 64-bit hashes of its distinct words, sorted, and their counts. Different
    words of a document count as one with a chance of about its words squared in 4 * 10^19."""
    hashed = F.transform(T.tokenize_words(F.col(text_col)), lambda w: F.xxhash64(w))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(hashed, F.array().cast("array<bigint>")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h = _rows_of(batch.column("h"))
            row, h, tf = _summed(row, h, np.ones(len(h), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(row, batch.num_rows, h), _lists(row, batch.num_rows, tf.astype(np.int32))], ["id", "h", "tf"])

    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"id {kind}, h array<bigint>, tf array<int>"), "word-counts")


def _known(frequency: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(h, df, power): the most frequent words, sorted by hash: those of df >= 2**power, as many as fit. 1 if these are all."""
    power = F.floor(F.log2("df")).cast("int")
    sizes, total, least = frequency.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("p")).collect(), 0, 64
    for size in sizes:
        total += size.n
        if total > most:
            break
        least = size.p
    else:
        least = 1
    got = frequency.filter(power >= least).toArrow()
    h, df = got.column("h").to_numpy(), got.column("df").to_numpy()
    order = np.argsort(h)
    return h[order], df[order].astype(np.int32), least


def similarities(df: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__a, __b, similarity) of each pair of `asked` (__a, __b) whose documents are both there, once.

    Weights are counts times ln((1 + n) / (1 + df)) + 1. A pair is worked out in the task where the rows of both meet. What words
    in one document alone weigh is known; those in between, if there are more than KNOWN in all, get their weights by a join.
    """
    counted = word_counts(df, id_col, text_col)
    n = counted.count()
    frequency = counted.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    frequency = materialize(frequency, "frequencies")
    known, often, power = _known(frequency, KNOWN)
    sent = df.sparkSession.sparkContext.broadcast((known, np.log((1.0 + n) / (1.0 + often)) + 1.0))
    alone = float(np.log((1.0 + n) / 2.0) + 1.0)

    def found(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a word is known, its inverse frequency, or that of a word in one document)."""
        keys, idf = sent.value
        if not len(keys):
            return np.zeros(len(h), bool), np.full(len(h), alone)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        there = keys[at] == h
        return there, np.where(there, idf[at], alone)

    kind = counted.schema["id"].dataType.simpleString()
    none = F.array().cast("array<bigint>").alias("rh"), F.array().cast("array<double>").alias("rw")
    rows = counted.select("id", "h", "tf", *none)
    if power > 1:

        def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, h = _rows_of(batch.column("h"))
                tf, (there, _) = _rows_of(batch.column("tf"))[1], found(h)
                lists = [_lists(row[some], batch.num_rows, x[some]) for some in (there, ~there) for x in (h, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], ["id", "h", "tf", "oh", "otf"])

        split = materialize(counted.mapInArrow(parted, f"id {kind}, h array<bigint>, tf array<int>, oh array<bigint>, otf array<int>"), "parted-words")
        others = split.select("id", F.explode(F.arrays_zip("oh", "otf")).alias("o")).select("id", F.col("o.oh").alias("h"), F.col("o.otf").alias("tf"))
        less = frequency.filter(F.floor(F.log2("df")) < power)
        weight = F.col("tf") * (F.log((1.0 + n) / (1.0 + F.coalesce("df", F.lit(1)))) + 1.0)
        weighed = others.join(less, "h", "left").groupBy("id").agg(F.collect_list(F.struct("h", weight.alias("w"))).alias("o"))
        kept = split.select("id", "h", "tf").join(weighed, "id", "left")
        rows = kept.select("id", "h", "tf", F.coalesce("o.h", none[0]).alias("rh"), F.coalesce("o.w", none[1]).alias("rw"))
    repeated = counted.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id is not null").select("id")
    if not repeated.isEmpty():
        # The other words of an id's rows are with each of its rows already.
        whole = rows.join(repeated, "id").groupBy("id").agg(F.flatten(F.collect_list("h")).alias("h"), F.flatten(F.collect_list("tf")).alias("tf"), F.first("rh").alias("rh"), F.first("rw").alias("rw"))
        rows = rows.join(repeated, "id", "left_anti").unionByName(whole)
    if power > 1:
        rows = materialize(rows, "weighed-words")
    sides = [rows.toDF(f"__{s}", *(f"{c}_{s}" for c in ("h", "tf", "rh", "rw"))) for s in "ab"]
    met = asked.distinct().join(sides[0], "__a").join(sides[1], "__b")
    met = met.select("__a", "__b", *(f"{c}_{s}" for s in "ab" for c in ("h", "tf", "rh", "rw")))

    def side(batch: pa.RecordBatch, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (row, h), (more, rh) = _rows_of(batch.column(f"h_{s}")), _rows_of(batch.column(f"rh_{s}"))
        weight = _rows_of(batch.column(f"tf_{s}"))[1] * found(h)[1]
        return _summed(np.concatenate([row, more]), np.concatenate([h, rh]), np.concatenate([weight, _rows_of(batch.column(f"rw_{s}"))[1]]))

    def cosines(batch: pa.RecordBatch) -> np.ndarray:
        count = batch.num_rows
        (ra, ha, wa), (rb, hb, wb) = side(batch, "a"), side(batch, "b")
        norm = np.sqrt(np.bincount(ra, wa * wa, count)) * np.sqrt(np.bincount(rb, wb * wb, count))
        row, h, w = np.concatenate([ra, rb]), np.concatenate([ha, hb]), np.concatenate([wa, wb])
        order = np.lexsort((h, row))
        row, h, w = row[order], h[order], w[order]
        both = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
        dot = np.bincount(row[both], w[both] * w[both + 1], count)
        return np.divide(dot, norm, out=np.zeros(count), where=norm > 0)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = sum(batch.column(f"{c}_{s}").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for s in "ab" for c in ("h", "rh"))
            part = np.cumsum(lengths) // AT_ONCE
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
                some = batch.slice(int(at[0]), len(at)) if len(at) else batch
                yield pa.RecordBatch.from_arrays([some.column("__a"), some.column("__b"), pa.array(cosines(some))], ["__a", "__b", "similarity"])

    kinds = [f"{c} {met.schema[c].dataType.simpleString()}" for c in ("__a", "__b")]
    return met.mapInArrow(compared, ", ".join([*kinds, "similarity double"]))
