"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: each node hands its larger (large) or its smaller (small) neighbours to its smallest."""
    if large:
        sides = links.union(links.select(F.col("b"), F.col("a"))).toDF("node", "other")
    else:
        sides = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = sides.groupBy("node").agg(F.min("other").alias("low"))
    least = least.withColumn("low", F.least("low", "node"))
    handed = sides.join(least, "node")
    if large:
        handed = handed.filter(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("low").alias("b"))
    else:
        handed = handed.select(F.col("other").alias("a"), F.col("low").alias("b")).union(least.select(F.col("node"), F.col("low")))
    return handed.filter("a != b").distinct()


def _print(links: DataFrame) -> tuple:
    """Count and order-free checksums of a link set, to see when it no longer changes."""
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, root being the smallest node of its component.

    `links` has columns a and b of one orderable type, no nulls. Each step groups by node with
    map-side minima, so a hub's links are never gathered; the joins that hand them on are plain
    equi-joins, whose hot keys adaptive execution splits. Steps, about log(n) of them, end in
    tables in the shared folder, so a lost executor costs one step at most; a step's table replaces the one before.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    seen = _print(now)
    while seen[0]:
        now = materialize(_star(_star(now, True), False), "links", instead_of=now)
        if (then := _print(now)) == seen:
            break
        seen = then
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
