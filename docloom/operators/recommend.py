"""Recommendation by similarity over categorical and numeric columns, or vectors, with a weighted vote."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from .search import nearest_rows

#: Queries that one pass over the history takes.
QUERY_BLOCK = 2_000


def fit_scaler(hist: DataFrame, num_cols: list[str]) -> DataFrame:
    """One row: mean and population deviation of each numeric column (c_mean, c_std; 0 acts as 1, and a mean of nothing is 0)."""
    stats = [x for c in num_cols for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    row = hist.agg(*stats)
    return row.select(*[x for c in num_cols for x in (F.coalesce(f"{c}_mean", F.lit(0.0)).alias(f"{c}_mean"), F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(1.0).alias(f"{c}_std"))])


def fit_categories(hist: DataFrame, cat_cols: list[str]) -> DataFrame:
    """(column, value): the known values of each categorical column."""
    made = [hist.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct() for c in cat_cols]
    return reduce(DataFrame.union, made)


def save_model(hist: DataFrame, cat_cols: list[str], num_cols: list[str], path: str) -> None:
    """Write the fitted statistics and known values as Parquet."""
    fit_scaler(hist, num_cols).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    fit_categories(hist, cat_cols).write.mode("overwrite").parquet(f"{path}/categories")


def load_or_fit_model(spark: SparkSession, hist: DataFrame, cat_cols: list[str], num_cols: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """(scaler, categories) from the path, fitted and saved first if nothing is there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/categories")
    except AnalysisException:
        save_model(hist, cat_cols, num_cols, path)
        return spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/categories")


def similarity(queries: DataFrame, hist: DataFrame, cat_cols: list[str], num_cols: list[str], id_col: str, query_id: str = "query_id") -> DataFrame:
    """(query_id, id, similarity) of each query against each history row.

    The one-hot and standardised vectors are never made: their dot product is the number of equal
    categories plus the products of z-values, and their norms are as plain; a value that the
    history doesn't have is all zeros, and so is a query's null number, as if it were the mean. Queries are a stated set that goes over the history in
    blocks of bounded size; each block is packed into one array column, so the history isn't shuffled.
    """
    scaler = fit_scaler(hist, num_cols).first()
    known = _known(queries, hist, cat_cols)

    def z(c: str, value: float | None) -> float:
        return 0.0 if value is None else (float(value) - scaler[f"{c}_mean"]) / scaler[f"{c}_std"]

    def scan(block: list) -> DataFrame:
        rows = []
        for r in block:
            cats, nums = [None if r[c] is None else str(r[c]) for c in cat_cols], [z(c, r[c]) for c in num_cols]
            norm = (sum(r[f"__k_{c}"] for c in cat_cols) + sum(v * v for v in nums)) ** 0.5
            rows.append((r[query_id], cats, nums, norm))
        kind = queries.schema[query_id].dataType.simpleString()
        packed = queries.sparkSession.createDataFrame(rows, f"q {kind}, cats array<string>, nums array<double>, norm double")
        return _against(F.broadcast(packed), hist, cat_cols, num_cols, id_col, query_id, scaler)

    made = [scan(block) for block in _blocks(known)] or [scan([])]
    return reduce(DataFrame.union, made)


def _known(queries: DataFrame, hist: DataFrame, cat_cols: list[str]) -> DataFrame:
    """The queries with 1 or 0 in __k_c for each category c: the history has the value."""
    for c in cat_cols:
        values = hist.select(F.col(c).cast("string").alias("__v")).distinct().withColumn(f"__k_{c}", F.lit(1))
        queries = queries.join(values, queries[c].cast("string") == F.col("__v"), "left").drop("__v").withColumn(f"__k_{c}", F.coalesce(f"__k_{c}", F.lit(0)))
    return queries


def _against(packed: DataFrame, hist: DataFrame, cat_cols: list[str], num_cols: list[str], id_col: str, query_id: str, scaler) -> DataFrame:
    """One block of queries against the history: a broadcast of at most QUERY_BLOCK rows."""
    zs = [((F.col(c) - F.lit(scaler[f"{c}_mean"])) / F.lit(scaler[f"{c}_std"])) for c in num_cols]
    rows = hist.select(F.col(id_col).alias("__h"), F.array(*[F.col(c).cast("string") for c in cat_cols]).alias("hc"), F.array(*zs).alias("hz"))
    rows = rows.withColumn("hn", F.sqrt(F.lit(float(len(cat_cols))) + sum((F.col("hz")[i] * F.col("hz")[i] for i in range(len(num_cols))), F.lit(0.0))))
    met = rows.crossJoin(packed)
    dot = sum((F.when(F.col("hc")[i] == F.col("cats")[i], 1.0).otherwise(0.0) for i in range(len(cat_cols))), F.lit(0.0)) + sum((F.col("hz")[i] * F.col("nums")[i] for i in range(len(num_cols))), F.lit(0.0))
    base = F.col("hn") * F.col("norm")
    return met.select(F.col("q").alias(query_id), F.col("__h").alias(id_col), F.when(base > 0, dot / base).otherwise(0.0).alias("similarity"))


def similarity_totals(queries: DataFrame, hist: DataFrame, cat_cols: list[str], num_cols: list[str], query_id: str = "query_id") -> DataFrame:
    """(query_id, n, total): how many similarity() values each query has and their sum, without making them.

    A similarity is a sum of products of something of the query and something of the row, each over its norm. So rows
    are added up first, 1 / norm by category and z / norm over all, and each query meets these sums: time is linear in
    both tables. Rows with a null number and those without length count, with a similarity of 0, as in similarity().
    """
    scaler = fit_scaler(hist, num_cols).first()

    def z(c: str) -> Column:
        return (F.col(f"`{c}`") - F.lit(scaler[f"{c}_mean"])) / F.lit(scaler[f"{c}_std"])

    rows = hist.select(*[F.col(f"`{c}`").cast("string").alias(f"__c{i}") for i, c in enumerate(cat_cols)], *[z(c).alias(f"__z{j}") for j, c in enumerate(num_cols)])
    squares = sum((F.col(f"__z{j}") * F.col(f"__z{j}") for j in range(len(num_cols))), F.lit(float(len(cat_cols))))
    rows = rows.withColumn("__w", F.when(squares > 0, 1 / F.sqrt(squares)))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(f"__z{j}") * F.col("__w")), F.lit(0.0)).alias(f"s{j}") for j in range(len(num_cols))]).first()
    asked = queries.select(F.col(f"`{query_id}`").alias("__q"), *[F.col(f"`{c}`").cast("string").alias(f"__q{i}") for i, c in enumerate(cat_cols)], *[F.coalesce(z(c), F.lit(0.0)).alias(f"__z{j}") for j, c in enumerate(num_cols)])
    for i in range(len(cat_cols)):
        sums = rows.groupBy(F.col(f"__c{i}").alias("__v")).agg(F.coalesce(F.sum("__w"), F.lit(0.0)).alias(f"__s{i}"))
        asked = asked.join(sums, F.col(f"__q{i}") == F.col("__v"), "left").drop("__v")
    dot = sum((F.coalesce(f"__s{i}", F.lit(0.0)) for i in range(len(cat_cols))), F.lit(0.0)) + sum((F.col(f"__z{j}") * F.lit(whole[f"s{j}"]) for j in range(len(num_cols))), F.lit(0.0))
    norm = F.sqrt(sum((F.when(F.col(f"__s{i}").isNotNull(), 1.0).otherwise(0.0) for i in range(len(cat_cols))), F.lit(0.0)) + sum((F.col(f"__z{j}") * F.col(f"__z{j}") for j in range(len(num_cols))), F.lit(0.0)))
    summed = asked.select(F.col("__q").alias(query_id), F.when(norm > 0, dot / norm).otherwise(0.0).alias("total"))
    # Without history no query has a value.
    return summed.filter(F.lit(whole["n"] > 0)).groupBy(query_id).agg((F.count(F.lit(1)) * F.lit(whole["n"])).alias("n"), F.sum("total").alias("total"))


def top_similar(scored: DataFrame, n: int = 5, id_col: str = "id", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, similarity, rank): the n best of each query, ties by descending id; Spark keeps n a
    query in each task before the shuffle."""
    best = Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.desc(id_col))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def nearest(queries: DataFrame, hist: DataFrame, cat_cols: list[str], num_cols: list[str], id_col: str = "id", query_id: str = "query_id", n: int = 5) -> DataFrame:
    """(query_id, id, similarity, rank): top_similar() of similarity(), without a row for each query and history row.

    Queries are a table like any other and meet only the cells of the history that may hold one of their n best (see
    search.py). History rows without some number are left out; a query's null number is the mean, its null category
    is like none; equal similarities go by descending id, null last.
    """
    scaler = fit_scaler(hist, num_cols).first()

    def prepared(df: DataFrame, key: str, name: str, known: Column) -> DataFrame:
        zs = [((F.col(f"`{c}`") - F.lit(scaler[f"{c}_mean"])) / F.lit(scaler[f"{c}_std"])).cast("double") for c in num_cols]
        made = df.select(F.col(f"`{key}`").alias(name), F.array(*[F.col(f"`{c}`").cast("string") for c in cat_cols]).cast("array<string>").alias("cats"), F.array(*zs).cast("array<double>").alias("nums"), known.cast("double").alias("__known"))
        made = made.withColumn("nums", F.transform("nums", lambda x: F.coalesce(x, F.lit(0.0)))) if name == "query_id" else made.filter(~F.exists("nums", lambda x: x.isNull()))
        return made.withColumn("norm", F.sqrt(F.aggregate("nums", F.col("__known"), lambda s, x: s + x * x))).drop("__known")

    known = sum((F.col(f"__k_{c}") for c in cat_cols), F.lit(0))
    asked = prepared(_known(queries, hist, cat_cols), query_id, "query_id", known).withColumn("own", F.lit(None).cast(hist.schema[id_col].dataType))
    found = nearest_rows(asked, prepared(hist, id_col, "id", F.lit(len(cat_cols))), n)
    return found.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "similarity", "rank")


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Queries in lists of QUERY_BLOCK; the driver holds one partition and one list at a time."""
    held = []
    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            yield held
            held = []
    if held:
        yield held


def weighted_vote(top: DataFrame, label_col: str, query_id: str = "query_id") -> DataFrame:
    """(query_id, predicted, confidence): the label with the highest sum of similarities, ties by best rank."""
    votes = top.groupBy(query_id, label_col).agg(F.sum("similarity").alias("s"), F.min("rank").alias("r"))
    summed = votes.groupBy(query_id).agg(F.max(F.struct(F.col("s"), (-F.col("r")).alias("r"), F.col(label_col).alias("label"))).alias("best"), F.sum("s").alias("total"))
    return summed.select(query_id, F.col("best.label").alias("predicted"), (F.col("best.s") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("confidence"))


def recommend(queries: DataFrame, hist: DataFrame, cat_cols: list[str], num_cols: list[str], label_col: str, id_col: str = "id", query_id: str = "query_id", n: int = 5) -> DataFrame:
    """(query_id, predicted, confidence, top, message): top is the n best rows, an array of structs in rank order.
    The vote is that of weighted_vote(), taken inside the row over those few."""
    best = nearest(queries, hist, cat_cols, num_cols, id_col, query_id, n)
    shown = [c for c in dict.fromkeys([*cat_cols, *num_cols, label_col]) if c != id_col]
    record = F.struct("rank", id_col, *shown, "similarity")
    tops = best.join(hist.select(id_col, *shown), id_col).groupBy(query_id).agg(F.sort_array(F.collect_list(record)).alias("top"))

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["similarity"])

    def vote(top: Column, r: Column) -> Column:
        return F.struct(total(F.filter(top, lambda x: x[label_col].eqNullSafe(r[label_col]))).alias("s"), (-r["rank"]).alias("r"), r[label_col].alias("label"))

    voted = tops.withColumn("__v", F.array_max(F.transform("top", lambda r: vote(F.col("top"), r)))).withColumn("__t", total(F.col("top")))
    confidence = F.col("__v.s") / F.when(F.col("__t") == 0, 1.0).otherwise(F.col("__t"))
    return voted.select(query_id, F.col("__v.label").alias("predicted"), confidence.alias("confidence"), "top", F.lit(R.RECOMMENDATION).alias("message"))


def knn_classify(queries: DataFrame, vectors: DataFrame, n: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(query_id, predicted, confidence) of each query vector against all others, in the cells that may hold one of its n
    nearest. Null vectors are left out; null numbers in one are 0; vectors are of one length."""

    def prepared(df: DataFrame, name: str) -> DataFrame:
        nums = F.transform(vector_col, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
        made = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias(name), F.array().cast("array<string>").alias("cats"), nums.alias("nums"))
        return made.withColumn("norm", F.sqrt(F.aggregate("nums", F.lit(0.0), lambda s, x: s + x * x)))

    found = nearest_rows(prepared(queries, "query_id").withColumn("own", F.col("query_id")), prepared(vectors, "id"), n)
    top = found.join(vectors.select(F.col(id_col).alias("id"), label_col), "id")
    return weighted_vote(top, label_col)


def valid_query(df: DataFrame) -> Column:
    """True for rows with month 1..12, humidity 0..100, wind of 0 or more and nothing missing."""
    fine = F.col("month").between(1, 12) & F.col("humidity_pct").between(0, 100) & (F.col("wind_kmh") >= 0) & F.col("location").isNotNull() & F.col("temperature_c").isNotNull()
    return F.coalesce(fine, F.lit(False))
