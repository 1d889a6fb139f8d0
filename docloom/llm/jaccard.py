"""Near copies by the Jaccard similarity of their sets of word shingles, for the pipeline's SimHash stage.

First candidates are SimHash's links at a few bits, found in the Gray-order index, and, as 64 bits can't tell
a similarity of 0.8 from a lower one, neighbours in Gray order among sets that agree on a key: a band of
minima of their hashes or, in the exact mode, a hash of their prefix. What these leave apart is then compared
whole wherever sets of different groups share a key. Every link is verified over whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .components import connected_components
from .gray_index import gray_rank
from .simhash import bits_of, keep_first, links, shingle_hashes

#: Bands of minima and minima in a band: two sets at 0.8 share a band with a chance of 0.9996, at 0.5 of 0.47.
BANDS, ROWS = 20, 5
#: Differing bits of SimHash's own links.
LIMIT = 4
#: Hashes whose minima are taken at once.
AT_ONCE = 2048
#: What a part of the sets compared with each other may weigh, in hashes, and what a set weighs beside its own.
PART, SET = 1 << 21, 1 << 12
#: Sets of either side, and hashes, whose overlaps are counted at once.
TILE, WIDE = 256, 4096


def recall(share: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two sets of this similarity share a band and so are compared."""
    return 1 - (1 - share**rows) ** bands


def _odd_numbers(n: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(b"minimum", i) | 1 for i in range(n)], np.uint64)


def set_id(found: np.ndarray) -> int:
    """The hash of a set, given as its sorted distinct hashes, as a signed long; 0 for the empty set."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(found.tobytes())) if len(found) else 0


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def bands(found: np.ndarray, factors: np.ndarray) -> list[int]:
    """A hash of each band of the set's minima: hashes times an odd number each are as many orders of them."""
    import xxhash

    if not len(found):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        np.minimum(least, (found[at : at + AT_ONCE, None] * factors).min(axis=0), out=least)
    return [_signed(xxhash.xxh64_intdigest(least[at : at + ROWS].tobytes(), at)) for at in range(0, len(least), ROWS)]


def prefix(found: np.ndarray) -> list[int]:
    """So many of the set's lowest hashes that any set at 0.8 or more has one of them among its own."""
    return found[: len(found) - -(-4 * len(found) // 5) + 1].view(np.int64).tolist() if len(found) else []


def _sketches(keyed: DataFrame, text_col: str, size: int, exact: bool = False) -> DataFrame:
    """(id, fp, size, bits, rank, keys) of each text: the set's hash and size, SimHash's bits and their Gray rank, the
    bands or, if exact, the prefix. Narrow."""
    factors = _odd_numbers(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(t or b"", size)
                found = np.unique(hashes)
                made.append((set_id(found), len(found), bits_of(hashes), prefix(found) if exact else bands(found, factors)))
            codes = np.array([m[2] for m in made], np.uint64)
            columns = [pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)]
            columns += [pa.array(codes.view(np.int64)), pa.array(gray_rank(codes).view(np.int64)), pa.array([m[3] for m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "fp", "size", "bits", "rank", "keys"])

    kind = keyed.schema["k"].dataType.simpleString()
    return keyed.select("k", text_col).mapInArrow(run, f"id {kind}, fp long, size long, bits long, rank long, keys array<long>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(sid, hashes) of each text, its only column. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t or b"", size)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["sid", "hashes"])

    return texts.mapInArrow(run, "sid long, hashes array<long>")


def alike(overlap: Column, a: Column, b: Column) -> Column:
    """Sets of sizes a and b with such an overlap have a Jaccard similarity of 0.8 or more."""
    return 9 * overlap >= 4 * (a + b)


def neighbours(distinct: DataFrame) -> DataFrame:
    """Candidates (a, b): each set with the one before it, and with the first, of those that share a key, in Gray order.

    Two candidates a row at most, no pairs of a group; what they leave apart is for _between().
    """
    return _met(distinct)[0]


def _met(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """neighbours(), and (key, fp) of all sets that share a key with another (and a few more, where tasks meet).

    Rows are range-partitioned by key and Gray rank, so a key that a third of all sets share is
    spread over tasks, each of which streams its sorted rows; where a task's rows end inside a key, its
    last set is paired with the next task's first.
    """
    from pyspark import TaskContext

    rows = distinct.select(F.explode("keys").alias("key"), "rank", "fp", "size")
    ordered = rows.repartitionByRange("key", "rank", "fp").sortWithinPartitions("key", "rank", "fp").select("key", "fp", "size")
    names = ["a", "b", "part", "first_key", "first", "last_key", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None

        def members(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(prints), none, none, pa.array(keys), none, none, none], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            begins = first is None
            first = first or (int(now[0][0]), int(now[1][0]))
            # The first and the last row of the run that the last batch ended in come before the rows.
            key, fp, size = (np.concatenate(x) for x in zip(held, now, strict=True)) if held else now
            new = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            shared = ~new | np.append(~new[1:], False)
            # A task's first and last row may share a key with another task's; held rows may be given twice.
            shared[0] |= begins
            yield members(key[shared], fp[shared])
            at = np.flatnonzero(~new)
            a, b = np.concatenate([at - 1, start[at]]), np.concatenate([at, at])
            fits = (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])) & (fp[a] != fp[b])
            a, b = fp[a[fits]], fp[b[fits]]
            if len(a):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none, none, none], names)
            keep = np.unique([start[-1], len(key) - 1])
            held = [x[keep] for x in (key, fp, size)]
        if held:
            yield members(held[0][-1:], held[1][-1:])
            ends = [None, None, TaskContext.get().partitionId(), *first, int(held[0][-1]), int(held[1][-1])]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in ends], names)

    found = materialize(ordered.mapInArrow(run, ", ".join(f"{n} long" for n in names)), "neighbours")
    # One row for each task.
    order = Window.orderBy("part")
    ends = found.filter("part is not null").select("last_key", "last", F.lead("first_key").over(order).alias("next_key"), F.lead("first").over(order).alias("next"))
    across = ends.filter("last_key = next_key and last != next").select(F.least("last", "next").alias("a"), F.greatest("last", "next").alias("b"))
    return found.filter("b is not null").select("a", "b").union(across), found.filter("a is not null and b is null").select(F.col("first_key").alias("key"), F.col("a").alias("fp"))


def _by_simhash(distinct: DataFrame) -> DataFrame:
    """Candidates (a, b) from SimHash: sets with the same bits, and links of the Gray-order index."""
    named = materialize(distinct.filter("size > 0").groupBy("bits").agg(F.min("fp").alias("rep")), "bits")
    same = distinct.join(named, "bits").filter("fp != rep").select(F.least("fp", "rep").alias("a"), F.greatest("fp", "rep").alias("b"))
    found = links(named.select(F.col("bits").alias("fp")), named.count(), LIMIT)
    both = found.join(named.toDF("a", "ra"), "a").join(named.toDF("b", "rb"), "b")
    return same.union(both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))


def _links(keyed: DataFrame, prints: DataFrame, text_col: str, size: int, exact: bool) -> DataFrame:
    """Links (a, b) between sets, each verified: first candidates, then those between the groups that these make."""
    distinct = materialize(prints.drop("id").dropDuplicates(["fp"]), "sets")
    near, members = _met(distinct)
    asked = materialize(_by_simhash(distinct).union(near).distinct(), "candidates")
    needed = asked.select(F.col("a").alias("fp")).union(asked.select("b")).union(members.select("fp")).distinct()
    first = prints.select("id", "fp").join(needed, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("k")).select("k.__dl_id", "k.__dl_tie")
    texts = keyed.select("k.__dl_id", "k.__dl_tie", text_col).join(first, ["__dl_id", "__dl_tie"], "left_semi")
    sets = materialize(_sets(texts.select(text_col), size).dropDuplicates(["sid"]), "needed-sets")
    both = asked.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
    verified = materialize(both.filter(alike(F.size(F.array_intersect("ha", "hb")), F.size("ha"), F.size("hb"))).select("a", "b"), "verified")
    return verified.union(_between(members, verified, distinct, sets, exact))


def _parts(rows: DataFrame) -> DataFrame:
    """`rows` (block, root, fp, size) with their part: runs of rows in that order that weigh about PART, by range partitions."""
    by = ["block", "root", "fp"]
    placed = materialize(rows.repartitionByRange(*by).withColumns({"task": F.spark_partition_id(), "weight": F.col("size") + SET}), "weighed")
    inside = F.sum("weight").over(Window.partitionBy("task").orderBy(*by))
    # One row for each task.
    before = F.coalesce(F.sum("w").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("task").agg(F.sum("weight").alias("w")).select("task", before.alias("before"))
    return placed.withColumn("inside", inside).join(F.broadcast(offsets), "task").select("fp", "root", F.floor((F.col("before") + F.col("inside")) / PART).alias("part"))


def _between(members: DataFrame, verified: DataFrame, distinct: DataFrame, sets: DataFrame, exact: bool) -> DataFrame:
    """Links (a, b) that join the groups made by `verified` wherever sets of two of them share a key and are alike.

    Only keys in which several groups meet matter. Their sets are put in order so that those that meet, at first or
    second hand, are neighbours, and dealt into parts of bounded weight; a task compares two parts that share such a key, so each set is
    sent once for each part that it meets, most often its own alone. Pairs are made inside the task and never written:
    it gives one link fewer than groups that it joins.
    """
    roots = connected_components(verified).toDF("fp", "root")
    grouped = members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("fp").alias("first")).filter("low != high")
    mixed = materialize(grouped.join(several.select("key", "first"), "key"), "mixed")
    blocks = connected_components(mixed.select(F.col("fp").alias("a"), F.col("first").alias("b"))).toDF("fp", "block")
    sized = mixed.select("fp", "root").distinct().join(blocks, "fp").join(distinct.select("fp", "size", "keys"), "fp")
    parts = materialize(_parts(sized.drop("keys")), "parts")
    there = materialize(mixed.select("key", "fp").join(parts, "fp").groupBy("key", "part").agg(F.min("root").alias("low"), F.max("root").alias("high")), "keys-of-parts")
    met = there.toDF("key", "i", "low_i", "high_i").join(there.toDF("key", "j", "low_j", "high_j"), "key").filter("i <= j and least(low_i, low_j) != greatest(high_i, high_j)")
    units = materialize(met.select("i", "j").distinct(), "units")
    sides = units.select("i", "j", F.col("i").alias("part")).union(units.filter("i != j").select("i", "j", F.col("j").alias("part")))
    whole = parts.join(distinct.select("fp", "keys"), "fp").join(sets.toDF("fp", "hashes"), "fp")
    rows = sides.join(whole, "part").select("i", "j", "part", "root", "fp", "keys", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            found = joined(unit, exact)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return rows.repartition("i", "j").sortWithinPartitions("i", "j", "part", "root", "fp").mapInArrow(run, "a long, b long")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal i and j, whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        i, j = (batch.column(c).to_numpy() for c in (0, 1))
        cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (i[a], j[a]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x for c in column.chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the sorted distinct sets a has in common with each of b: products of 0/1 matrices."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (a, b)]
    common = np.intersect1d(*[np.unique(h) for h, _ in sides], assume_unique=True)
    counts = np.zeros((len(a), len(b)), np.int64)
    placed = []
    for hashes, owner in sides:
        at = np.searchsorted(common, hashes)
        held = at < len(common)
        held[held] = common[at[held]] == hashes[held]
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], owner[held][order]))
    for low in range(0, len(common), WIDE):
        matrices = []
        for (at, owner), n in zip(placed, (len(a), len(b)), strict=True):
            some = slice(*np.searchsorted(at, [low, low + WIDE]))
            matrix = np.zeros((n, min(WIDE, len(common) - low)), np.float32)
            matrix[owner[some], at[some] - low] = 1
            matrices.append(matrix)
        counts += (matrices[0] @ matrices[1].T).astype(np.int64)
    return counts


def joined(unit: pa.Table, exact: bool) -> list[tuple[int, int]]:
    """Links (fp, fp) that join the groups of one or two parts, for all pairs that are alike and, unless exact, share a
    band at the same place. Tiles of TILE sets a side bound the memory; groups that are already one aren't compared again."""
    part, root, fp = (unit.column(c).to_numpy() for c in ("part", "root", "fp"))
    keys, sets = _lists(unit.column("keys")), _lists(unit.column("hashes"))
    size = np.array([len(s) for s in sets])
    label, found = np.unique(root, return_inverse=True)[1], []
    second = int(np.searchsorted(part, part[0], side="right"))
    rows, columns = range(0, second, TILE), range(0, len(fp), TILE) if second == len(fp) else range(second, len(fp), TILE)
    for r in rows:
        one = np.arange(r, min(r + TILE, second))
        for c in columns:
            two = np.arange(c, min(c + TILE, len(fp)))
            if second == len(fp) and c < r:
                continue
            apart = (label[one][:, None] != label[two]) & (5 * np.minimum(size[one][:, None], size[two]) >= 4 * np.maximum(size[one][:, None], size[two]))
            if not exact and apart.any():
                bands_one, bands_two = np.array([keys[x] for x in one]), np.array([keys[x] for x in two])
                meet = np.zeros(apart.shape, bool)
                for band in range(bands_one.shape[1]):
                    meet |= bands_one[:, band][:, None] == bands_two[:, band]
                apart &= meet
            x, y = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            if not len(x):
                continue
            common = overlaps([sets[i] for i in one[x]], [sets[i] for i in two[y]])
            ok = apart[np.ix_(x, y)] & (9 * common >= 4 * (size[one[x]][:, None] + size[two[y]]))
            for i, j in np.argwhere(ok).tolist():
                a, b = int(one[x[i]]), int(two[y[j]])
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    found.append((int(fp[a]), int(fp[b])))
    return found


def keep_one_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, exact: bool = False) -> DataFrame:
    """The documents, all columns, one of each group whose sets of `size`-word shingles have, in turn, a
    Jaccard similarity of 0.8 or more: that which simhash.keep_one() would take of it.

    No text goes that isn't linked by verified pairs of whole sets, told apart by 64-bit hashes. Two sets are
    compared if they share one of 20 bands, which a pair at 0.8 misses with a chance of 1 - recall(0.8), once in
    2,800, and one above it less often; `exact` compares all that share a hash of their prefixes and misses none,
    at a cost that grows with common shingles. Neither caps the candidates. Equal sets are merged before. Null texts
    and those without words are one group.
    Ids may be null or repeat; rows equal in id and text are one document. Other columns are carried
    along; an empty table gives an empty result.
    """

    def grouped(keyed: DataFrame, prints: DataFrame) -> DataFrame:
        roots = connected_components(_links(keyed, prints, text_col, size, exact)).toDF("fp", "root")
        return prints.select("fp").distinct().join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    return keep_first(docs, id_col, text_col, lambda keyed: _sketches(keyed, text_col, size, exact), grouped)
