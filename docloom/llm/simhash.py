"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch
from .components import connected_components
from .gray_index import gray_rank, link_all

#: Shingles whose bits are counted at once, fingerprints that should share a key of a table, and the most
#: of a key that one task takes; larger keys are split.
COUNTED, SHARED, GROUP = 1 << 15, 256, 1 << 15


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each of a UTF-8 text's shingles, repeats included: A-Z lower-cased, ASCII white
    space between words, one for each run of `size` words. Fewer words make one shingle, none give none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest, view = xxhash.xxh64_digest, memoryview(joined)
    hashes = b"".join([digest(view[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)])
    return np.frombuffer(hashes, ">u8").astype(np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes: bits set in over half of them; 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, size: int = 4) -> int:
    """The SimHash of a UTF-8 text; 0 without words."""
    return bits_of(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp) of each document: fp is the fingerprint's bits as a signed long. A null text is empty. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def banding(n: int, limit: int) -> list[list[int]]:
    """Bit masks, as lists of (first bit, bits) blocks, such that two of `n` fingerprints with at most
    `limit` differing bits agree on all blocks of one list. With b blocks, at least b - limit have no
    difference; the smallest b is taken at which about SHARED random fingerprints share a table's key."""
    for b in range(limit + 1, 2 * limit + 1):
        if n / 2 ** (64 * (b - limit) / b) <= SHARED:
            break
    edges = [round(64 * i / b) for i in range(b + 1)]
    blocks = [(edges[i], edges[i + 1] - edges[i]) for i in range(b)]
    made = [list(c) for c in combinations(blocks, b - limit)]
    assert len(made) == comb(b, limit)
    return made


def links(distinct: DataFrame, n: int, limit: int, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all within `limit` bits into the same components.

    Every fingerprint goes once to each table of banding(); those with the same key meet in one
    task, where the hierarchical index in Gray order links them. A key of more than `group` members is dealt
    into parts by a hash, and each pair of parts is a group of its own, so every two members still
    meet and no task gets more than two parts at once. A group of g gives at most g - 1 links, whatever the
    number of its pairs, so large groups of near copies don't square. Tasks stream their sorted
    rows and hold one group.
    """
    masks = [sum(((1 << bits) - 1) << at for at, bits in table) for table in banding(n, limit)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"))
    if n > group:
        parts = F.ceil(F.col("n") / (group // 2)).cast("int")
        large = materialize(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("t", "key", parts.alias("parts")), "large-keys")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        # The pairs of parts that hold one's own: (0, own), ..., (own, own), ..., (own, parts - 1); (own, own) is within the others.
        pairs = F.filter(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.when(p != own, F.least(p, own) * F.col("parts") + F.greatest(p, own))), lambda x: x.isNotNull())
        keyed = keyed.join(large, ["t", "key"], "left").select("fp", "t", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("unit"))
    else:
        keyed = keyed.withColumn("unit", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(columns: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links of the groups between the cuts."""
            codes, (starts, ends) = columns[0].view(np.uint64), (cuts[:-1], cuts[1:])
            more = ends - starts > 1
            below, above = [], []
            for a, b in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
                members = codes[a:b]
                members = members[np.argsort(gray_rank(members))]
                up = link_all(members, limit)
                hit = np.flatnonzero(up != np.arange(len(up)))
                if len(hit):
                    below.append(members[hit])
                    above.append(members[up[hit]])
            if below:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (below, above)], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held and all(x[0] == now[i][0] == now[i][-1] for i, x in enumerate(held[-1]) if i):
                held.append(now)  # still the group that the rows before ended in
                continue
            rows = [np.concatenate([h[i] for h in held] + [now[i]]) for i in range(4)]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[1:]], axis=0)) + 1
            done = cuts[-1] if len(cuts) else 0
            yield from linked([x[:done] for x in rows], np.concatenate([[0], cuts])) if done else ()
            held = [[x[done:] for x in rows]]
        if held:
            rows = [np.concatenate([h[i] for h in held]) for i in range(4)]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[1:]], axis=0)) + 1
            yield from linked(rows, np.concatenate([[0], cuts, [len(rows[0])]]))

    sorted_rows = keyed.repartition("t", "key", "unit").sortWithinPartitions("t", "key", "unit").select("fp", "t", "key", "unit")
    return sorted_rows.mapInArrow(run, "a long, b long")


def _grouped(prints: DataFrame, limit: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of `prints` (id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = links(distinct.select("fp"), distinct.count(), limit)
    roots = connected_components(found).toDF("fp", "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, limit: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of each document.

    Fingerprints with at most `limit` differing bits link; component_id is the smallest id that can
    be reached. Exact copies share a fingerprint and are merged before anything is compared, so a
    group of copies is one row in the search. The search compares distinct fingerprints only within
    the keys of banding(), exactly. Documents without words share the zero fingerprint.

    Null texts count as empty. Null ids never name a component unless it has no other; repeated
    ids are separate rows of equal standing. Other columns are ignored; an empty table gives an
    empty result. Fingerprints and links stay in tables, which go when the result, a table too, is
    written; the driver sees counts only.
    """
    with scratch(docs.sparkSession):
        prints = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
        rooted = _grouped(prints, limit)
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
        found = prints.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return materialize(found, "groups", keep=True)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, limit: int = 4) -> DataFrame:
    """The documents, all columns, one of each group of near_duplicates(): that with the smallest id
    (null last), of rows that share it that with the smallest text hash, of equal rows any."""
    return keep_first(docs, id_col, text_col, lambda keyed: fingerprints(keyed, "k", text_col, size), lambda _, prints: _grouped(prints.select(F.col("id")[id_col].alias("id"), "fp"), limit))


def keep_first(docs: DataFrame, id_col: str, text_col: str, marked: Callable[[DataFrame], DataFrame], grouped: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """One document of each group, as keep_one() chooses it. `marked` gives (id, fp) of rows (k, text), `grouped` (fp, root) of both."""
    # No id is written as the one that stands for null.
    key = {"__dl_id": F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), "__dl_tie": F.xxhash64(text_col)}
    keyed = docs.withColumns(key)
    rows = keyed.select(F.struct(id_col, "__dl_id", "__dl_tie").alias("k"), text_col)
    prints = materialize(marked(rows), "fingerprints")
    rooted = grouped(rows, prints)
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("id")[id_col].isNull().alias("no"), F.col("id").alias("k"))).alias("first"))
    kept = rooted.join(least, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.k.__dl_id", "first.k.__dl_tie").distinct()
    # The join and the removal of equal rows share one partitioning.
    return keyed.join(kept, ["__dl_id", "__dl_tie"], "left_semi").dropDuplicates(["__dl_id", "__dl_tie"]).select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate groups of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
