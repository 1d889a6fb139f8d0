"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times. The whole part is certain; the
fraction is rounded by a pivotal walk: the document at hand and the next one trade expected words,
a random one of two moves of equal mean, until one of them is taken or left for good. The words
expected in all never change, so only the last document of a walk is open. Walks run over buckets
of documents; their last documents meet in the walks of the next, smaller round, up to one tree
root a source. A source's taken words so miss its target by less than its root's last document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WORD, global_rank, materialize, scratch

#: Weights of the sources in order, repeating; share of all sizes that the mix has; most copies of a document.
WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
#: Documents in a bucket of the first round, open documents in one of the later rounds.
BUCKET, FAN_IN = 4096, 1024
SEED = 20240


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) of each source of `sized` (source, size).

    Sources are ranked by code point, null last, and get the weights in turn. The total is shared by
    weight; a source takes at most `most` times its size, and what is over goes to the others by
    weight, again until none is above. The rounds hold sums only, never the sources.
    """
    summed = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = global_rank(summed, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.withColumn("weight", weight), "sources")
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * level >= most * F.col("source_size") if full >= 0 else F.lit(False)
        taken, open_weight, now = sources.agg(F.sum(F.when(capped, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(capped.cast("int"))).first()
        if not open_weight or now == full:
            break
        level, full = (total * everything - taken) / open_weight, now
    target = F.least(F.col("weight") * level, most * F.col("source_size")) if full >= 0 else F.lit(0.0)
    return sources.select("source", "source_size", "n", target.cast("double").alias("target"))


def _uniform(seed: int, *keys: object) -> float:
    """A number in [0, 1) that depends on the keys alone, so reruns and retries agree."""
    import xxhash

    return (xxhash.xxh64_intdigest(repr(keys), seed) >> 11) / (1 << 53)


def pivot(rows: Iterator[tuple], seed: int) -> Iterator[tuple[object, float]]:
    """Walk over (row, name, size, fraction): each row comes out with fraction 0 or 1, but for the last, which may stay open.

    With x = size * fraction words expected of each of two documents and room y = size - x, either
    min(room of a, words of b) move from b to a, or min(words of a, room of b) from a to b, with
    the chances that keep both means. One row is held at a time.
    """
    held = None
    for row, name, size, part in rows:
        if part <= 0 or part >= 1 or size <= 0:
            yield row, float(part >= 1)
            continue
        if held is None:
            held = [row, name, size, size * part]
            continue
        a, b = held, [row, name, size, size * part]
        up, down = min(a[2] - a[3], b[3]), min(a[3], b[2] - b[3])
        move = up if _uniform(seed, a[1], b[1]) * (up + down) < down else -down
        a[3], b[3], held = a[3] + move, b[3] - move, None
        for x in (a, b):
            end = _settled(x[2], x[3])
            if end is None and held is None:
                held = x
            else:
                yield x[0], float(2 * x[3] >= x[2]) if end is None else end
    if held is not None:
        yield held[0], held[3] / held[2]


def _settled(size: float, words: float) -> float | None:
    """0 or 1 if a document is left or taken for good, up to rounding errors of its size; else None."""
    near = 1e-9 * size
    return 0.0 if words <= near else 1.0 if words >= size - near else None


def round_copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds `taken_copies` to (source, key, size, n, rate), where rate is the expected number of copies.

    Rounds: bucket the open documents of each source by a hash of the key, as many buckets as its
    documents need, walk each bucket, hand on its last document. A hot source only has more buckets.
    The order in a bucket is that of sizes and key hashes, so a walk trades between like sizes, and
    nothing depends on how Spark happens to partition. What is settled goes to a table each round.
    """
    kept_fields = [f for f in docs.schema.fields if f.name not in ("source", "key", "size", "n", "rate")]
    schema = docs.select("source", "key", "size", "rate", *[f.name for f in kept_fields]).schema.add("part", "double").add("bucket", "long")
    names, arrow = schema.fieldNames(), to_arrow_schema(schema)
    at = {n: i for i, n in enumerate(names)}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for _, group in groupby(rows, lambda r: (r[at["source"]], r[at["bucket"]])):
            for r, part in pivot(_named(group, at), seed):
                out.append((*r[: at["part"]], part, r[at["bucket"]]))
                if len(out) >= 8192:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    spread = F.pmod(F.xxhash64("key", "size", F.lit(seed)), F.greatest(F.ceil(F.col("n") / BUCKET), F.lit(1)))
    open_docs = docs.withColumn("part", F.col("rate") - F.floor("rate")).withColumn("bucket", spread).select(*names)
    settled = []
    while True:
        dealt = open_docs.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), F.xxhash64("key", F.lit(seed + 1)), "key", *[f.name for f in kept_fields])
        walked = materialize(dealt.mapInArrow(walk, schema), "walk")
        still = (F.col("part") > 0) & (F.col("part") < 1)
        settled.append(walked.filter(~still))
        most, left = walked.filter(still).agg(F.max("bucket"), F.count(F.lit(1))).first()
        if not left:
            break
        if not most:
            # One open document a source: taken with its own chance.
            chance = F.pmod(F.xxhash64("source", "key", F.lit(seed + 2)), F.lit(1 << 30)) / F.lit(1 << 30)
            settled.append(walked.filter(still).withColumn("part", (chance < F.col("part")).cast("double")))
            break
        open_docs = walked.filter(still).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    done = settled[0]
    for more in settled[1:]:
        done = done.union(more)
    return done.withColumn("taken_copies", (F.floor("rate") + F.col("part")).cast("long")).drop("part", "bucket")


def _named(rows: Iterator[tuple], at: dict[str, int]) -> Iterator[tuple]:
    """(row, name, size, fraction), the name being the key and the place among equal keys, which follow each other."""
    last, place = None, 0
    for r in rows:
        key = r[at["key"]]
        place = place + 1 if key == last else 0
        last = key
        yield r, (key, place), r[at["size"]], r[at["part"]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, copies) of each document.

    Size is the number of words. Documents without words (null or empty texts) take nothing from
    the mix: taken is 0. A null source is a source, ranked last. Ids may be null or repeat: each row
    is rounded by itself. Other columns are ignored; an empty table gives an empty result. Equal
    input gives equal results, whatever the partitioning.

    Text is read once; what is shuffled are ids, sizes and sources. Sources meet in one row each,
    joined back by source; no task holds more than a bucket of documents. The tables of the rounds go
    when the result, a table too, is written.
    """
    with scratch(docs.sparkSession):
        sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
        found = _mixed(sized, weights, total, most, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.col("taken_copies").alias("copies"))
        return materialize(found, "mixed", keep=True)


def _mixed(sized: DataFrame, weights: Sequence[float], total: float, most: float, seed: int) -> DataFrame:
    """taken and taken_copies for (id, source, size, ...) rows."""
    goal = materialize(targets(sized, weights, total, most), "targets")
    known = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    rated = known.withColumns({"key": F.coalesce(F.col("id").cast("string"), F.lit("")), "rate": rate})
    rounded = round_copies(rated, seed)
    return rounded.withColumn("taken", F.col("taken_copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it; none that it leaves out.

    Rows that agree in id, source and text are one document here, of the size of all of them, and
    are taken equally often. Documents without words stay once: they weigh nothing.
    """
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("hash"))
    rows = docs.select(key.alias("__dl_k"), word_count(F.col(text_col)).alias("size"))
    sized = materialize(rows.groupBy("__dl_k").agg(F.sum("size").alias("size")).select("__dl_k.*", "size"), "sized")
    done = _mixed(sized, weights, total, most, seed)
    copies = done.select(F.struct("id", "source", "hash").alias("__dl_k"), F.when(F.col("size") == 0, 1).otherwise(F.col("taken_copies")).cast("int").alias("__dl_copies")).filter("__dl_copies > 0")
    taken = docs.withColumn("__dl_k", key).join(copies, "__dl_k")
    return taken.withColumn("__dl_copy", F.explode(F.sequence(F.lit(1), F.col("__dl_copies")))).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: what is taken of each."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
