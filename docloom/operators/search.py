"""Exact search for the rows of highest cosine, in cells that can't all be skipped.

Vectors have equal-or-not categories and numbers. Rows are dealt into cells: the nearest of some pivot rows, and the ring
of the angle to it; rings have about as many rows each, by a sample. The angle between a query and a row is at least the difference of their angles to any pivot, so the
least and highest angle of a cell's rows to each bound the cosine of everything in it. A query first looks into its most promising cells; then, as it knows its
n-th best, into those others whose bound isn't below. Cells are searched in blocks, each against the queries that
need it, by a matrix product; what that leaves is worked out term by term, so equal rows have equal cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..scratch import materialize, scratch

#: Pivots, and rings around one on average, at most, and rows that a cell should have; there are fewer cells if rows are few.
PIVOTS, RINGS, CELL = 128, 64, 250
#: Rows of the sample, for each cell, by which rings are bordered.
SAMPLE = 8
#: Rows in a block, and queries that meet it in one task.
BLOCK, CHUNK = 4096, 20_000
#: Bounds of a query and a cell that a task works out.
BOUNDS = 1 << 22
#: Ranges of angles, a cell and a pivot each, that are kept.
RANGES = 131_072
#: Room for rounding in bounds.
ROOM = 1e-9

VECTOR = ["cats", "nums", "norm"]


@dataclass
class Vectors:
    """Categories (codes of one list of values), numbers and norms of some rows."""

    cats: np.ndarray
    nums: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch, codes: dict, m: int, width: int, query: bool) -> Vectors:
        """From columns cats, nums, norm. codes gets new values; a null category equals another row's, but no query's."""
        whole = [table.column(c) for c in ("cats", "nums", "norm")]
        lists, nums, norm = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole)
        n = table.num_rows
        cats = np.zeros((n, m), np.int64)
        if m and n:
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            known = np.array([codes.setdefault(v, len(codes)) for v in coded.dictionary.to_pylist()] + [-1 if query else -2])
            cats = known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)].reshape(n, m)
        return Vectors(cats, nums.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width), norm.to_numpy(zero_copy_only=False))

    def take(self, rows: np.ndarray) -> Vectors:
        return Vectors(self.cats[rows], self.nums[rows], self.norm[rows])

    def cosines(self, other: Vectors) -> np.ndarray:
        """Of each row with each of the other's; 0 where a norm is 0."""
        dot = self.nums @ other.nums.T
        for j in range(self.cats.shape[1]):
            dot += self.cats[:, j : j + 1] == other.cats[:, j]
        base = self.norm[:, None] * other.norm
        return np.divide(dot, base, out=np.zeros_like(dot), where=base > 0)

    def one_by_one(self, i: int, other: Vectors, rows: np.ndarray) -> np.ndarray:
        """Cosines of row i with these of the other's rows, each in the same order of its terms."""
        dot = (self.cats[i] == other.cats[rows]).sum(axis=1).astype(np.float64)
        near = np.zeros(len(rows))
        for j in range(self.nums.shape[1]):
            near = near + other.nums[rows, j] * self.nums[i, j]
        base = other.norm[rows] * self.norm[i]
        return np.divide(dot + near, base, out=np.zeros(len(rows)), where=base > 0)


@dataclass
class Cells:
    """Pivots as (cats, nums, norm), the borders of the rings around each, and for each cell that has rows its number and
    rows, its own pivot, and a row of the least and of the highest angles to the first pivots and, last, to its own."""

    pivots: list[tuple]
    m: int
    width: int
    borders: list[np.ndarray]
    number: np.ndarray | None = None
    rows: np.ndarray | None = None
    own: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def angles(self, batch: pa.Table | pa.RecordBatch, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """(angle to each pivot, norm) of a batch's rows."""
        codes: dict = {}
        kinds = pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()
        table = pa.table([pa.array([p[i] for p in self.pivots], kind) for i, kind in enumerate(kinds)], VECTOR)
        pivots = Vectors.of(table, codes, self.m, self.width, False)
        rows = Vectors.of(batch, codes, self.m, self.width, query)
        return np.arccos(np.clip(rows.cosines(pivots), -1.0, 1.0)), rows.norm

    def border(self, sample: pa.Table, wanted: int) -> None:
        """Rings of about equal numbers of the sample's rows, `wanted` in all."""
        angle, norm = self.angles(sample, False)
        pivot, least = angle.argmin(axis=1), angle.min(axis=1)
        for p in range(len(self.pivots)):
            own = np.sort(least[(pivot == p) & (norm > 0)])
            rings = max(1, round(wanted * len(own) / len(least)))
            self.borders.append(np.unique(own[np.arange(1, rings) * len(own) // rings]))

    def cell(self, angle: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The cell of each row; -1 of rows without length."""
        pivot, least = angle.argmin(axis=1), angle.min(axis=1)
        first = np.cumsum([0, *(len(b) + 1 for b in self.borders)])
        cell = first[pivot]
        for p in np.unique(pivot):
            own = pivot == p
            cell[own] += np.searchsorted(self.borders[p], least[own], "right")
        return np.where(norm > 0, cell, -1)

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        """The highest cosine that each query may have in each cell."""
        angle, norm = self.angles(batch, True)
        least = np.zeros((len(norm), len(self.number)))
        for p in range(self.low.shape[1]):
            to = angle[:, p : p + 1] if p < self.low.shape[1] - 1 else angle[:, self.own]
            least = np.maximum(least, np.maximum(to - self.high[:, p], self.low[:, p] - to))
        return np.where((norm == 0)[:, None] | (self.number < 0), 0.0, np.cos(least)) + ROOM

    def first(self, bound: np.ndarray, n: int) -> np.ndarray:
        """For each query the cells with the highest bounds that hold n rows together."""
        # Cells have rows, so n of them suffice; the last is the first to be left out.
        most = min(n, bound.shape[1])
        order = np.argpartition(-bound, most - 1, axis=1)[:, :most]
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(bound, order, axis=1), axis=1, kind="stable"), axis=1)
        rows = self.rows[order]
        taken = np.zeros(bound.shape, np.bool_)
        np.put_along_axis(taken, order, np.cumsum(rows, axis=1) - rows < n, axis=1)
        return taken


def _dealt(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows with their cell; rows without length have the cell -1."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = sent.value.cell(*sent.value.angles(batch, False))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def _measure(celled: DataFrame, cells: Cells) -> None:
    """Fill in what cells has of its rows: sums, least and highest angles of tasks, RANGES of them a task at most, meet by cell and pivot."""
    rings = [len(b) + 1 for b in cells.borders]
    witnesses = 1 + max(1, min(len(cells.pivots), RANGES // (sum(rings) + 1)))
    sent = celled.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                angle = sent.value.angles(batch, False)[0][order]
                angle = np.column_stack([angle[:, : witnesses - 1], angle.min(axis=1)])
                own, starts, n = np.unique(cell[order], return_index=True, return_counts=True)
                low, high = np.minimum.reduceat(angle, starts), np.maximum.reduceat(angle, starts)
                for i, c in enumerate(own.tolist()):
                    had = held.get(c)
                    held[c] = (int(n[i]), low[i], high[i]) if had is None else (had[0] + int(n[i]), np.minimum(had[1], low[i]), np.maximum(had[2], high[i]))
        if held:
            columns = [np.repeat(list(held), witnesses), np.tile(np.arange(witnesses), len(held)), np.repeat([h[0] for h in held.values()], witnesses), np.concatenate([h[1] for h in held.values()]), np.concatenate([h[2] for h in held.values()])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cell", "pivot", "n", "low", "high"])

    found = celled.select(*VECTOR, "cell").mapInArrow(run, "cell long, pivot long, n long, low double, high double")
    met = found.groupBy("cell", "pivot").agg(F.sum("n"), F.min("low"), F.max("high")).toPandas().sort_values(["cell", "pivot"]).to_numpy()
    by = met.reshape(-1, witnesses, 5)
    cells.number, cells.rows = by[:, 0, 0].astype(np.int64), by[:, 0, 2].astype(np.int64)
    # Rows without length have no pivot; their bound is 0 anyway.
    cells.own = np.repeat(np.arange(len(rings)), rings)[np.maximum(cells.number, 0)]
    cells.low, cells.high = by[:, :, 3], by[:, :, 4]


def _needed(queries: DataFrame, cells: Cells, n: int, again: bool) -> DataFrame:
    """(qn, cats, nums, norm, own, floor, cell): the cells that each query looks into first, or, knowing its `floor`, again."""
    sent = queries.sparkSession.sparkContext.broadcast(cells)
    names = ["qn", *VECTOR, "own", "floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value.number.astype(np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                bound = sent.value.bounds(batch)
                taken = sent.value.first(bound, n)
                if again:
                    floor = np.nan_to_num(batch.column("floor").to_numpy(zero_copy_only=False), nan=-2.0)
                    taken = ~taken & (bound >= floor[:, None] - ROOM)
                q, c = np.nonzero(taken)
                if len(q):
                    kept = pa.RecordBatch.from_arrays([batch.column(x) for x in names], names).take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers[c])], [*names, "cell"])

    schema = T.StructType([*(queries.schema[x] for x in names), T.StructField("cell", T.IntegerType())])
    # A query takes few bytes of a file, but its bounds take time.
    dealt = queries.select(*names).repartition(-(-queries.count() * len(cells.number) // BOUNDS), "qn")
    return dealt.mapInArrow(run, schema)


def _binned(summary: Iterator[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(cell, bin, parts) of (cell, rows): neighbouring small cells share a bin of BLOCK rows, a large cell is dealt into parts."""
    made, bin_, held = [], 0, 0
    for cell, rows in summary:
        if held and held + rows > BLOCK:
            bin_, held = bin_ + 1, 0
        made.append((cell, bin_, -(-rows // BLOCK)))
        held += rows
    return made


def _chunked(needed: DataFrame, bins: DataFrame) -> DataFrame:
    """(cell, bin, parts, chunks) of the cells that some query needs; a bin has a chunk for each CHUNK of its own queries, so
    its rows are sent once unless that many meet them, however many queries there are in all."""
    asks = needed.groupBy("cell").agg(F.count(F.lit(1)).alias("asks"))
    own = F.sum("asks").over(Window.partitionBy("bin"))
    return materialize(bins.join(asks, "cell").select("cell", "bin", "parts", F.ceil(own / CHUNK).cast("int").alias("chunks")).coalesce(1), "chunks")


def _looked(needed: DataFrame, rows: DataFrame, bins: DataFrame, n: int, m: int, width: int) -> DataFrame:
    """(qn, id, similarity): the n best of each query in each block of the cells that it needs."""
    kind = rows.schema["id"].dataType
    needed = materialize(needed, "needed")
    placed = _chunked(needed, bins)
    asked = needed.join(F.broadcast(placed), "cell").withColumn("chunk", F.pmod(F.xxhash64("qn"), "chunks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "chunks")
    # Rows of cells that nobody needs stay where they are.
    met = rows.join(F.broadcast(placed.toDF("of_cell", "in_bin", "of_parts", "of_chunks")), F.col("cell") == F.col("of_cell"))
    dealt = met.select("id", *VECTOR, "cell", F.col("in_bin").alias("bin"), F.explode(F.sequence(F.lit(0), F.col("of_chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("rn"), "of_parts").cast("int").alias("part"))

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        held = held.take(pc.sort_indices(held, sort_keys=[("id", "descending")], null_placement="at_end"))
        if asked.num_rows and held.num_rows:
            codes: dict = {}
            every, all_asked = Vectors.of(held, codes, m, width, False), Vectors.of(asked, codes, m, width, True)
            cell, cell_asked, own = held.column("cell").to_numpy(), asked.column("cell").to_numpy(), held.column("id").to_pylist()
            mine, floors, number = asked.column("own").to_pylist(), np.nan_to_num(asked.column("floor").to_numpy(), nan=-2.0), asked.column("qn").to_numpy()
            places: dict[object, list[int]] = {}
            if any(x is not None for x in mine):
                for i, x in enumerate(own):
                    places.setdefault(x, []).append(i)
            for c in np.unique(cell_asked):
                here, those = np.flatnonzero(cell == c), np.flatnonzero(cell_asked == c)
                rows = every.take(here)
                for some in np.array_split(those, -(-len(those) // 256)) if len(here) else ():
                    queries = all_asked.take(some)
                    cosines = queries.cosines(rows)
                    for i, q in enumerate(some):
                        score = cosines[i]
                        if mine[q] is not None and mine[q] in places:
                            score[np.isin(here, places[mine[q]])] = -np.inf
                        least = np.partition(score, len(score) - n)[len(score) - n] if len(score) > n else -2.0
                        close = np.flatnonzero(score >= max(least, floors[q], -2.0) - ROOM)
                        if len(close):
                            exact = queries.one_by_one(i, rows, close)
                            best = np.argsort(-exact, kind="stable")[:n]
                            names.append(np.full(len(best), number[q]))
                            ids.append(here[close[best]])
                            scores.append(exact[best])
        found = held.column("id").combine_chunks().take(pa.array(np.concatenate(ids)))
        return pa.table([pa.array(np.concatenate(names)), found, pa.array(np.concatenate(scores))], ["qn", "id", "similarity"])

    key = ["bin", "part", "chunk"]
    schema = T.StructType([T.StructField("qn", T.LongType()), T.StructField("id", kind), T.StructField("similarity", T.DoubleType())])
    return asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(look, schema)


def nearest_rows(queries: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(query_id, id, similarity, rank): the n rows of highest cosine for each query, equal ones by descending id, null last.

    queries (query_id, cats, nums, norm, own) and rows (id, cats, nums, norm) have arrays of one length each without
    null numbers; a query's null category equals nothing; own is an id that isn't to be found, or null. What has a norm of
    0 has the similarity 0 to everything. Equal rows count each; ids may be null or repeat; each query is one of its
    own. Rows are read once into cells; a search sends a block of rows once for each
    20,000 queries that need its cells. No rows or no queries give an empty result.
    """
    spark = queries.sparkSession
    best = Window.partitionBy("qn").orderBy(F.desc("similarity"), F.desc("id"))
    with scratch(spark):
        asked = materialize(queries.withColumns({"qn": F.monotonically_increasing_id(), "floor": F.lit(None).cast("double")}), "asked")
        total, size = asked.count(), rows.count()
        if not total or not size:
            return spark.createDataFrame([], T.StructType([queries.schema["query_id"], rows.schema["id"], T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
        wanted = min(PIVOTS * RINGS, -(-size // CELL))
        most = min(PIVOTS, math.isqrt(4 * wanted) + 1)
        picked = rows.orderBy(F.xxhash64("id", "cats", "nums")).select(*VECTOR).limit(4 * most).collect()
        pivots = list({(tuple(r.cats), tuple(r.nums)): (r.cats, r.nums, r.norm) for r in picked if r.norm > 0}.values())[:most] or [(r.cats, r.nums, 1.0) for r in picked[:1]]
        m, width = len(pivots[0][0]), len(pivots[0][1])
        cells = Cells(pivots, m, width, [])
        cells.border(rows.orderBy(F.xxhash64("id", "cats", "nums")).select(*VECTOR).limit(SAMPLE * wanted).toArrow(), wanted)
        celled = materialize(_dealt(rows, cells).withColumn("rn", F.monotonically_increasing_id()), "cells")
        _measure(celled, cells)
        binned = zip(*_binned(zip(cells.number.tolist(), cells.rows.tolist(), strict=True)), strict=True)
        bins = spark.createDataFrame(pa.table([pa.array(x, pa.int32()) for x in binned], ["cell", "bin", "parts"]))
        # The query's own row may be among those that it meets first.
        first = materialize(_looked(_needed(asked, cells, n + 1, False), celled, bins, n, m, width), "first-found")
        floors = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == n).select("qn", F.col("similarity").alias("floor"))
        told = asked.drop("floor").join(floors, "qn", "left")
        more = _looked(_needed(told, cells, n + 1, True), celled, bins, n, m, width)
        ranked = first.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
        return materialize(ranked.join(asked.select("qn", "query_id"), "qn").select("query_id", "id", "similarity", "rank"), "nearest", keep=True)
