"""Audit of how sources differ in their words, by iceberg prefix refinement.

Texts are read once: a task turns each document into its different terms in byte order, and notes how long a prefix
each has in common with the one before it. A term brings its document to a prefix for the first time if it
shares less than the prefix with its predecessor, so documents of a prefix are a plain sum, and rows of
equal terms can be added up before anything is shuffled. Prefixes are then extended level by level, and terms
whose prefix has too few documents go at each, so the long tail of rare terms is never grouped whole. The counts of
sources lie beside these sums and are looked at for complete kept terms only.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch

#: A term in lower-cased UTF-8: letters of ASCII and all that isn't ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Bytes of the first level's prefixes; each level doubles them.
FIRST = 4
#: Documents of its language that a term needs, and terms that are reported for each source.
LEAST_DOCUMENTS, MOST_TERMS = 30, 50
#: Parts of a probability, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 5
#: Terms of documents that a task adds up at once; cells of a matrix of terms and sources.
CHUNK, CELLS = 2_500_000, 2_000_000
#: Prefixes or terms up to this number are sent to all tasks (some 30 MB); beyond it they are joined by a shuffle.
SENT = 200_000
#: More levels than any term has.
LEVELS = 32


def shared_levels(terms: list[bytes], order: np.ndarray) -> np.ndarray:
    """For places in a sequence of terms, given as their numbers, how many levels' prefixes each shares with the one before it."""
    packed = np.array(terms, f"S{4 * FIRST}").view(f"S{FIRST}").reshape(len(terms), 4)[order]
    same = packed[1:] == packed[:-1]
    second = same[:, 0] & same[:, 1]
    all_four = second & same[:, 2] & same[:, 3]
    shared = np.zeros(len(order), np.int64)
    shared[1:] = same[:, 0].astype(np.int64) + second + all_four
    for i in np.flatnonzero(all_four) + 1:
        level, a, b = 8 * FIRST, terms[order[i - 1]], terms[order[i]]
        while len(a) >= level and len(b) >= level and a[level // 2 : level] == b[level // 2 : level]:
            shared[i], level = shared[i] + 1, 2 * level
    return shared


class _Chunk:
    """Different terms of documents, numbered within their language, until they are added up."""

    def __init__(self) -> None:
        self.number = count()
        self.langs: dict[str, dict[bytes, int]] = {}
        self.terms: list[int] = []
        self.counts: list[int] = []
        self.starts: list[int] = []
        self.groups: list[int] = []

    def add(self, lang: str, group: int, found: Counter) -> None:
        known = self.langs.setdefault(lang, defaultdict(self.number.__next__))
        ordered = sorted(found)
        self.starts.append(len(self.terms))
        self.groups.append(group)
        self.terms += map(known.__getitem__, ordered)
        self.counts += map(found.__getitem__, ordered)

    def sums(self) -> dict[str, object]:
        """Columns of term_sums(): one row for each language, term and number of shared levels."""
        import pyarrow as pa

        names = [b""] * next(self.number)
        for known in self.langs.values():
            for term, i in known.items():
                names[i] = term
        owner = np.zeros(len(names), np.int32)
        for k, known in enumerate(self.langs.values()):
            owner[np.fromiter(known.values(), np.int64, len(known))] = k
        terms = np.array(self.terms, np.int64)
        shared = shared_levels(names, terms)
        shared[self.starts] = 0
        of = np.repeat(self.groups, np.diff([*self.starts, len(terms)]))
        wide = int(of.max()) + 1
        met, place = np.unique((terms * LEVELS + shared) * wide + of, return_inverse=True)
        docs, n = np.bincount(place), np.bincount(place, self.counts).astype(np.int64)
        first = np.flatnonzero(np.diff(met // wide, prepend=-1))
        term = met[first] // wide // LEVELS
        offsets = pa.array(np.append(first, len(met)), pa.int32())
        return {
            "lang": pa.DictionaryArray.from_arrays(pa.array(owner[term]), pa.array(list(self.langs), pa.string())).cast(pa.string()),
            "term": pa.array(names, pa.binary()).take(pa.array(term)),
            "shared": pa.array(met[first] // wide % LEVELS, pa.int32()),
            "docs": pa.array(np.add.reduceat(docs, first), pa.int64()),
            "groups": pa.ListArray.from_arrays(offsets, pa.array(met % wide, pa.int32())),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
        }


def term_sums(rows: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """(lang, term, shared, docs, groups, counts) in binary terms, of rows (lang, source, text): a task's documents of each
    term that shares so many levels with its predecessor, and its counts in groups, by their places in the list."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places, held = {g: i for i, g in enumerate(groups)}, _Chunk()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = Counter(TERM.findall(text.lower()))
                if found:
                    held.add(lang, places[lang, source], found)
                if len(held.terms) >= CHUNK:
                    made, held = held.sums(), _Chunk()
                    yield pa.RecordBatch.from_pydict(made)
        if held.terms:
            yield pa.RecordBatch.from_pydict(held.sums())

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "lang string, term binary, shared int, docs long, groups array<int>, counts array<long>")


def frequent_terms(sums: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms in `least_documents` documents of their language or more; `sums` as of term_sums().

    At each level, prefixes that are long enough are counted, and shorter terms, which are complete there, with
    them; whatever lies below the threshold takes its terms along. The last level is the one that no kept term exceeds.
    """
    now, level, number = sums.select("lang", "term", "shared", "docs"), FIRST, 0
    while True:
        size = F.length("term")
        rows = now.select("*", F.substring("term", 1, level).alias("prefix"), (size < level).alias("complete"))
        # Terms that were complete on the level before have been counted there.
        active = rows if not number else rows.filter(size >= level // 2)
        counted = active.filter((F.col("shared") <= number) | F.col("complete")).groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs"))
        kept = materialize(counted.filter(F.col("docs") >= least_documents).drop("docs"), "prefixes")
        left = active.join(_sent(kept), ["lang", "prefix", "complete"], "left_semi")
        if number:
            left = left.unionByName(rows.filter(size < level // 2))
            # Rows of equal terms from many tasks are added up once the rare ones are gone; later levels read a row each.
            left = left.groupBy("lang", "term", "shared").agg(F.sum("docs").alias("docs")) if number == 1 else left
            now = materialize(left.select("lang", "term", "shared", "docs"), "terms", instead_of=now if number > 1 else None)
            if (now.agg(F.max(F.length("term"))).first()[0] or 0) < level:
                return now.select("lang", "term").distinct()
        else:
            now = left.select("lang", "term", "shared", "docs")
        level, number = 2 * level, number + 1


def _sent(table: DataFrame) -> DataFrame:
    """A written table, to be sent to all tasks if it is small enough."""
    return F.broadcast(table) if table.count() <= SENT else table


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exact for any counts."""
    return 1 + F.call_function("div", (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + ADDED * terms).cast("decimal(20,0)")).cast("long")


def _distances(by_term: DataFrame, groups: list[tuple[str, str]], absent: list[int]) -> DataFrame:
    """(a, b, value): sums over terms of how far the probabilities of two groups of a language lie apart, a row a task and
    pair; `absent` has the groups' probability of a term that they don't have."""
    members: dict[str, list[int]] = defaultdict(list)
    for i, (lang, _) in enumerate(groups):
        members[lang].append(i)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = {i: k for own in members.values() for k, i in enumerate(own)}
        sums = {lang: np.zeros((len(own), len(own)), np.int64) for lang, own in members.items()}
        basis = {lang: np.array([absent[i] for i in own], np.int64) for lang, own in members.items()}

        def add(lang: str, rows: list) -> None:
            cells = np.tile(basis[lang], (len(rows), 1))
            for i, held in enumerate(rows):
                for h in held:
                    cells[i, place[h["group"]]] = h["p"]
            for i in range(cells.shape[1]):
                sums[lang][i] += np.abs(cells - cells[:, i : i + 1]).sum(axis=0)

        for batch in batches:
            waiting: dict[str, list] = defaultdict(list)
            for lang, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting[lang].append(held)
                if len(waiting[lang]) * len(members[lang]) >= CELLS:
                    add(lang, waiting.pop(lang))
            for lang, rows in waiting.items():
                add(lang, rows)
        for lang, made in sums.items():
            own = np.array(members[lang], np.int32)
            for i, row in zip(own, made, strict=True):
                met = np.flatnonzero(row)
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), i)), pa.array(own[met]), pa.array(row[met])], ["a", "b", "value"])

    return by_term.select("lang", "held").mapInArrow(run, "a int, b int, value long")


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how a language's sources differ from each other and in which terms.

    Part pair: the distance to each other source of the language, over all kept terms. Part term: the terms that are
    likelier in the source than in its language, the `most_terms` first. Null languages, sources and texts are empty
    ones. Each row is a document, repeated rows and rows without id too; a language without kept terms has
    distances of 0; an empty table gives an empty result. Other columns are ignored.

    Nothing but sums moves. Names and totals of the groups of language and source come to the driver: one row a
    group, where the result has one for each two groups of a language.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    spark = df.sparkSession
    with scratch(spark):
        rows = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
        groups = sorted(tuple(r) for r in rows.select("lang", "source").distinct().collect())
        names = spark.createDataFrame([(i, *g) for i, g in enumerate(groups)], "group int, lang string, source string")
        sums = materialize(term_sums(rows, groups), "term-sums")
        terms = materialize(frequent_terms(sums, least_documents), "kept-terms")
        counted = sums.select("lang", "term", "groups", "counts").join(_sent(terms), ["lang", "term"], "left_semi")
        pairs = counted.select("lang", "term", F.explode(F.arrays_zip("groups", "counts")).alias("c")).select("lang", "term", F.col("c.groups").alias("group"), F.col("c.counts").alias("n"))
        counts = materialize(pairs.groupBy("lang", "term", "group").agg(F.sum("n").alias("n")), "counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all"))
        known = names.join(kept, "lang", "left").join(counts.groupBy("group").agg(F.sum("n").alias("own")), "group", "left").na.fill(0, ["terms", "all", "own"])
        known = materialize(known.withColumn("absent", F.when(F.col("terms") > 0, probability(F.lit(0), F.col("own"), F.col("terms"))).otherwise(0)), "groups")
        absent = [r[0] for r in known.orderBy("group").select("absent").collect()]
        held = counts.join(known.select("group", "own", "terms", "all"), "group").withColumn("p", probability(F.col("n"), F.col("own"), F.col("terms")))
        by_term = held.groupBy("lang", "term", "terms", "all").agg(F.collect_list(F.struct("group", "p")).alias("held"), F.sum("n").alias("n"))
        by_term = materialize(by_term.withColumn("q", probability(F.col("n"), F.col("all"), F.col("terms"))), "by-term")
        met = _distances(by_term, groups, absent).groupBy("a", "b").agg(F.sum("value").alias("value"))
        other = names.select(F.col("group").alias("b"), "lang", F.col("source").alias("item"))
        pairs = names.withColumnRenamed("group", "a").join(other, "lang").filter("a != b").join(met, ["a", "b"], "left").na.fill(0, ["value"])
        likely = by_term.select(F.explode("held").alias("h"), F.col("term").cast("string").alias("item"), "q").select("h.group", "item", (F.col("h.p") - F.col("q")).alias("value")).filter("value > 0")
        best = likely.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= most_terms)
        near = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "item")))
        found = near.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
        found = found.unionByName(best.join(names, "group").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
        return materialize(found, "audit", keep=True)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS m FROM g LEFT JOIN v ON g.lang = v.lang),
l AS (SELECT c.lang, c.term, sum(c.n) AS n FROM c GROUP BY ALL),
lt AS (SELECT lang, sum(n) AS m FROM l GROUP BY lang),
q AS (SELECT l.lang, l.term, 1 + (CAST(1000000000 AS HUGEINT) * CAST(l.n + 5 AS HUGEINT)) // CAST(lt.m + 5 * v.v AS HUGEINT) AS q FROM l JOIN lt ON l.lang = lt.lang JOIN v ON l.lang = v.lang),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // CAST(s.m + 5 * s.v AS HUGEINT) AS p
      FROM s JOIN k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
tr AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
u AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value, rank FROM u WHERE part = 'pair' OR rank <= 50
"""
