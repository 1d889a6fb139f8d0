"""Merkle manifest of a table: a digest for each row, a tree for each source, one root, and a proof for each row.

Every run of 16 neighbouring nodes is one row that holds its digests. Proofs come from pointer jumping: each such node
points to its parent and holds the siblings on that step; joined with the node it points to it takes over that
node's segment and pointer, so the distance doubles with each self-join until all point beyond the root. Rows take
the segment of their run. Digests are lower-case hexadecimal SHA-256 over joined texts, everything a native expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch

#: Nodes in a run.
ARITY = 16
#: The columns of documents that a leaf holds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources' trees.
TOP = -1
#: A node: its tree, its level above the leaves, its place there.
NODE = ["tree", "level", "idx"]


def joined_digest(parts: Column) -> Column:
    """SHA-256 of the joined texts of an array."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 over the fields: '-' if null, else the number of UTF-8 bytes, ':' and the value."""
    texts = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _placed(hashed: DataFrame) -> DataFrame:
    """hashed with (tree, idx, n, trees): the rank of its source, its own rank there, rows of the source, number of sources.

    Rows are range-partitioned by source, id and digest, and numbered inside their partition, so a source of a third of
    all rows is spread. What is known of a source in a partition, one row each, gives the offsets.
    """
    by = ["source", "id", "leaf", "__tie"]
    ranged = hashed.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = materialize(ranged.drop("__tie").withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "leaves")
    pairs = rows.groupBy("part", "source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    sources = pairs.groupBy("source").agg(F.sum("held").alias("n"), F.min("part").alias("start"))
    # Sources that start in a partition are in it whole or at its end, so partitions give their order; one row a partition here.
    starts = sources.groupBy("start").agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("start", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("trees_before"), F.sum("here").over(Window.partitionBy()).alias("trees"))
    place = F.row_number().over(Window.partitionBy("start").orderBy("source"))
    named = sources.join(starts, "start").select(F.col("source").alias("s"), "n", (F.col("trees_before") + place - 1).alias("tree"), "trees")
    before = F.sum("held").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pairs.withColumn("before", F.coalesce(before, F.lit(0))).join(named, F.col("source").eqNullSafe(F.col("s"))).select(F.col("part").alias("p"), "s", "first", "before", "tree", "n", "trees")
    offsets = materialize(offsets, "offsets")
    met = rows.join(offsets, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return met.withColumn("idx", F.col("before") + F.col("place") - F.col("first")).drop("part", "p", "s", "place", "first", "before")


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """(tree, level, idx, run, digest, n) of the level above `nodes` (tree, idx, digest, n) in trees where several remain."""
    met = nodes.filter("n > 1").groupBy("tree", F.expr(f"idx div {ARITY}").alias("idx"), "n")
    runs = met.agg(F.sort_array(F.collect_list(F.struct((F.col("idx") % ARITY).alias("at"), "digest"))).alias("run"))
    runs = runs.select("tree", F.lit(level).alias("level"), "idx", F.transform("run", lambda x: x["digest"]).alias("run"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
    return materialize(runs.withColumn("digest", joined_digest(F.col("run"))), "runs")


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The runs of all levels above `nodes`, of which a tree has `most` at most."""
    made: list[DataFrame] = []
    while most > 1:
        made.append(_runs(made[-1] if made else nodes, len(made) + 1))
        most = -(-most // ARITY)
    return made


def _above(level: Column, trees: int) -> list[Column]:
    """tree, level and place of the parent of a node, and its own place among the children; null for the root."""
    inside, over = F.col("n") > 1, F.lit(trees > 1) & (F.col("tree") != TOP)

    def either(a: Column, b: Column) -> Column:
        return F.when(inside, a).when(over, b)

    return [
        either(F.col("tree"), F.lit(TOP)).alias("up_tree"),
        either(level + 1, F.lit(1)).alias("up_level"),
        either(F.expr(f"idx div {ARITY}"), F.expr(f"tree div {ARITY}")).alias("up_idx"),
        either(F.col("idx") % ARITY, F.col("tree") % ARITY).cast("int").alias("at"),
    ]


def _step(run: Column, at: Column) -> Column:
    """The siblings before and after a node's place in its run, each joined."""
    return F.struct(F.array_join(F.slice(run, F.lit(1), at), "").alias("before"), F.array_join(F.slice(run, at + 2, F.lit(ARITY)), "").alias("after"))


def _pointers(inner: DataFrame, trees: int, depth: int) -> DataFrame:
    """(tree, level, idx, run, steps, subroot): the inner nodes with all steps to the root."""
    up = ["up_tree", "up_level", "up_idx"]
    nodes = inner.select(*NODE, "run", F.when((F.col("tree") != TOP) & (F.col("n") == 1), F.col("digest")).alias("subroot"), *_above(F.col("level"), trees))
    parents = inner.select(*[F.col(c).alias(f"up_{c}") for c in NODE], F.col("run").alias("of"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    now = nodes.join(parents, up, "left").select(*NODE, "run", "subroot", *up, F.when(F.col("of").isNotNull(), F.array(_step(F.col("of"), F.col("at")))).otherwise(none).alias("steps"))
    now, reach = materialize(now, "pointers"), 1
    while reach < depth:
        # Pointers of many nodes meet in few ancestors; those are small tables, which Spark broadcasts by their size.
        there = now.select(*[F.col(c).alias(f"up_{c}") for c in NODE], *[F.col(c).alias(f"next_{c}") for c in [*up, "steps", "subroot"]])
        met = now.join(there, up, "left")
        further = met.select(*NODE, "run", F.coalesce("subroot", "next_subroot").alias("subroot"), *[F.col(f"next_{c}").alias(c) for c in up], F.concat("steps", F.coalesce("next_steps", none)).alias("steps"))
        now, reach = materialize(further, "pointers", instead_of=now), 2 * reach
    return now.drop(*up)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and the siblings on its way give."""
    return F.aggregate(steps, leaf, lambda made, s: F.sha2(F.concat(s["before"], made, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 over all siblings of a proof, level by level, left to right."""
    return joined_digest(F.transform(steps, lambda s: F.concat(s["before"], s["after"])))


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, altered: dict[str, Column] | None = None) -> DataFrame:
    """(id, source, leaf, altered, subroot, root, steps) of each row; altered is the digest with these columns replaced, if asked for.

    In a source, leaves ascend by id, null first, equal ids by digest; sources ascend by UTF-8 bytes, null first, and
    null is a source. Equal rows are leaves of their own. Null and empty texts differ. A table of one row has that
    leaf as root and a proof without steps; an empty table gives an empty result. Columns that aren't fields are ignored.
    """
    other = F.lit(None).cast("string") if altered is None else leaf_digest([altered.get(c, F.col(f"`{c}`")) for c in fields])
    hashed = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("source"), leaf_digest([F.col(f"`{c}`") for c in fields]).alias("leaf"), other.alias("altered"))
    with scratch(df.sparkSession):
        rows = _placed(materialize(hashed, "hashed"))
        size = rows.groupBy("trees").agg(F.max("n").alias("most")).first()
        if size is None:
            return rows.select("id", "source", "leaf", "altered", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.lit(None).cast("array<struct<before:string,after:string>>").alias("steps")).limit(0)
        trees, most = size
        leaves = rows.select("tree", "idx", F.col("leaf").alias("digest"), "n")
        inside = _levels(leaves, most)
        subroots = leaves.filter("n = 1")
        for runs in inside:
            subroots = subroots.union(runs.filter("n = 1").select("tree", "idx", "digest", "n"))
        tops = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(trees).alias("n"))
        over = _levels(tops, trees)
        ways = rows.select("id", "source", "leaf", "altered", *_above(F.lit(0), trees))
        if inside or over:
            inner = (inside + over)[0]
            for runs in (inside + over)[1:]:
                inner = inner.union(runs)
            root = inner.filter(F.col("n") == 1).filter((F.col("tree") == TOP) | F.lit(trees == 1)).first()["digest"]
            nodes = _pointers(inner, trees, len(inside) + len(over))
            met = ways.join(nodes.select(*[F.col(c).alias(f"up_{c}") for c in NODE], "run", "steps", "subroot"), ["up_tree", "up_level", "up_idx"], "left")
            steps = F.concat(F.array(_step(F.col("run"), F.col("at"))), F.col("steps"))
            found = met.select("id", "source", "leaf", "altered", F.coalesce("subroot", "leaf").alias("subroot"), F.lit(root).alias("root"), steps.alias("steps"))
        else:
            found = ways.select("id", "source", "leaf", "altered", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("steps"))
        return materialize(found, "manifest", keep=True)


def verify(df: DataFrame, made: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(id, source, verified): for each row of df whether its digest and some proof of its id and source in the manifest give the root.

    Rows that the manifest doesn't have, and altered ones, aren't verified; ids may be null or repeat.
    """
    now = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("source"), leaf_digest([F.col(f"`{c}`") for c in fields]).alias("leaf"))
    fine = made.select("id", "source", "leaf").filter(folded(F.col("leaf"), F.col("steps")) == F.col("root")).distinct().toDF("i", "s", "l")
    met = now.join(fine.withColumn("verified", F.lit(True)), F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("leaf") == F.col("l")), "left")
    return met.select("id", "source", F.coalesce("verified", F.lit(False)).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of all documents; a fifth of them is checked against texts whose capitals were lowered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    made = manifest(docs, altered={"text": F.when(changed, lowered).otherwise(F.col("text"))})
    # The fold and the proof's digest are worked out once a row, however often the result names them.
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.col("altered"), F.col("steps")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE f AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS k FROM documents),
d AS (SELECT r, doc_id, source, k,
  '' || CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(k) || ':' || k END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
     || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
  CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body, translate(CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  CASE WHEN k IS NULL THEN false ELSE xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 5 = 0 END AS changed FROM f),
h AS (SELECT r, doc_id, source, sha256(head || body) AS leaf, CASE WHEN changed THEN sha256(head || low) ELSE sha256(head || body) END AS other FROM d),
a AS (SELECT *, CAST(dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS BIGINT) AS tree, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS i, CAST(count(*) OVER (PARTITION BY source) AS BIGINT) AS n FROM h),
lv AS (SELECT tree, 0 AS l, i, leaf AS h, n FROM a
  UNION ALL SELECT tree, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM lv WHERE n > 1 GROUP BY tree, l, n, i // 16),
tp AS (SELECT CAST(-1 AS BIGINT) AS tree, 0 AS l, tree AS i, h, CAST((SELECT count(DISTINCT tree) FROM a) AS BIGINT) AS n FROM lv WHERE n = 1
  UNION ALL SELECT tree, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM tp WHERE n > 1 GROUP BY tree, l, n, i // 16),
nodes AS (SELECT * FROM lv UNION ALL SELECT * FROM tp),
s AS (SELECT tree, l, i, n, h,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY tree, l, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS b,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY tree, l, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS e FROM nodes),
w AS (SELECT r, tree, 0 AS l, i, other AS made, '' AS proof FROM a
  UNION ALL SELECT w.r, CASE WHEN s.n > 1 THEN w.tree ELSE -1 END, CASE WHEN s.n > 1 THEN w.l + 1 ELSE 0 END, CASE WHEN s.n > 1 THEN w.i // 16 ELSE w.tree END,
    CASE WHEN s.n > 1 THEN sha256(s.b || w.made || s.e) ELSE w.made END, w.proof || s.b || s.e
  FROM w JOIN s ON w.tree = s.tree AND w.l = s.l AND w.i = s.i WHERE s.n > 1 OR w.tree >= 0),
root AS (SELECT h AS root FROM tp WHERE n = 1),
fin AS (SELECT w.r, w.made, w.proof FROM w JOIN tp ON w.tree = -1 AND tp.l = w.l AND tp.i = w.i AND tp.n = 1)
SELECT a.doc_id, a.leaf, lv.h AS subroot, root.root, sha256(fin.proof) AS proof_sha256, fin.made AS folded_root, fin.made = root.root AS verified
FROM a JOIN fin ON a.r = fin.r JOIN lv ON lv.tree = a.tree AND lv.n = 1 CROSS JOIN root
"""
