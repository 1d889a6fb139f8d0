"""Host-level quality rules, in DataFrame functions only.

Each document is measured and judged by fixed rules; failures are added up by host, hosts' rates
are shrunk towards the corpus by a beta prior that is fitted to all hosts, and hosts with too high
a rate take their remaining documents with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

#: ASCII white space, as a class of Java's regular expressions.
SPACE = r"\x20\x09-\x0D"
#: Least words of a document, most of its words (in hundredths) in repeated windows, symbols that are counted.
LEAST_WORDS, MOST_REPEATED, SYMBOLS = 50, 50, "#*$%&|<>"
#: A host's shrunk failure rate from which its documents go.
HOST_RATE = 0.5


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def repeated_words(words: Column, windows: Column) -> Column:
    """Words that stand in a 3-word window found twice or more; `windows` are the windows' hashes in order.

    Only where some window repeats at all, windows are sorted by hash and place; a window with an
    equal neighbour is repeated. Each repeated window then adds the words that the one before it
    in the text didn't cover, three at most. Time is that of the sort, never of all pairs.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        def equal(x: Column, i: Column) -> Column:
            return ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"]))

        return F.sort_array(F.transform(F.filter(s, equal), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x)

    # A one-element array and a transform name the sorted array, so that it is made once.
    sorted_once = F.transform(F.array(placed), twice)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.element_at(F.transform(sorted_once, covered), 1)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each document; null texts have no word. Narrow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    start = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    window = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    found = start.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window.alias("windows"),
        F.col("words"),
    ).withColumn("n_repeat_words", repeated_words(F.col("words"), F.col("windows")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.drop("windows", "words").withColumn("base_failed", failed)


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, failed, rate): failure rates shrunk by an empirical beta prior.

    The prior's mean is the rate over all documents; its strength comes from how much hosts' own
    rates differ beyond chance (method of moments, weighted by documents), 1 document at least and
    1,000,000 at most. It is worked out in one row of sums that is joined to the hosts.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    sums = hosts.agg(F.sum("n").alias("all_n"), F.sum("failed").alias("all_failed"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("spread"), F.count(F.lit(1)).alias("k"))
    mean = F.col("all_failed") / F.col("all_n")
    # Weighted sum of squares between hosts, and what chance alone would give.
    between = F.col("spread") - F.col("all_n") * mean * mean
    chance = mean * (1 - mean)
    room = F.col("all_n") - F.col("squares") / F.col("all_n")
    excess = F.when(room > 0, (between - (F.col("k") - 1) * chance) / room).otherwise(0.0)
    strength = F.when(excess > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), chance / excess - 1))).otherwise(1e6)
    prior = sums.select(mean.alias("mean"), strength.alias("strength"))
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failed", rate.alias("rate"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each document.

    kept is false for documents that fail the rules themselves and for those of hosts whose shrunk
    failure rate is `host_rate` or more. Null and empty texts have no words and fail. Rows without
    a host are one host. Ids may be null or repeat; every row counts. Other columns are ignored;
    an empty table gives an empty result.

    Measuring is narrow. By host there are only map-side sums; verdicts, one row a host, are
    joined back to the measures, without texts.
    """
    with scratch(docs.sparkSession):
        measured = materialize(measures(docs, id_col, text_col, host_col), "measures")
        rates = host_rates(measured)
        bad = rates.filter(F.col("rate") >= host_rate).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
        judged = measured.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
        found = judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"))
        return materialize(found, "judged", keep=True)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality measures and host-level verdicts of all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
x AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE c > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN x ON w.r = x.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS failed FROM f GROUP BY source),
s AS (SELECT CAST(sum(n) AS DOUBLE) AS a, sum(failed) / sum(n) AS mean, CAST(sum(n * n) AS DOUBLE) AS sq, sum(failed * failed / n) AS spread, count(*) AS k FROM h),
e AS (SELECT mean, CASE WHEN a - sq / a > 0 THEN (spread - a * mean * mean - (k - 1) * mean * (1 - mean)) / (a - sq / a) ELSE 0 END AS excess FROM s),
q AS (SELECT mean, CASE WHEN excess > 0 THEN greatest(1.0, least(1e6, mean * (1 - mean) / excess - 1)) ELSE 1e6 END AS strength FROM e),
b AS (SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed) AND rate < 0.5 AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""
