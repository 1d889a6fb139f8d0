"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, exception phrases, length-normalised score.

Folding undoes what hides a word: upper case, accents, compatibility forms, look-alike letters of other
scripts, digits and signs for letters inside words, marks between letters. A lexicon entry is a whole word or the
beginning of words; entries and weights come from a built-in list and from labelled documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, in_hash_sample, materialize, scratch
from .tokens import kept

#: The model is fitted on about this many labelled rows; this alone bounds the learned entries.
TRAIN_ROWS = 20_000
#: Lengths of learned word beginnings, and how many labelled documents, and standard errors, an entry must have.
STEMS, LEAST_DOCS, LEAST_Z = range(4, 9), 8, 4.0
#: Weight of the entries below.
SEED_WEIGHT = 3.0

# Common English insults, phrases in which they aren't meant so, and look-alikes.
SEED = "idiot moron imbecile stupid dumbass loser scum trash garbage pathetic worthless disgusting clown creep jerk freak pig vermin filthy degenerate".split()
EXCEPTIONS = ["pathetic fallacy", "clown fish", "class clown", "trash can", "trash bin", "garbage collector", "garbage collection", "garbage can", "guinea pig", "pig iron", "control freak", "jerk chicken", "feature creep", "scope creep", "sore loser", "white trash can"]
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_LOOKALIKE = str.maketrans(LOOKALIKES)
_SIGN = str.maketrans(SIGNS)
#: A stretch of letters, digits and letter-like signs that holds both a letter and a sign in letter's place.
_MIXED = re.compile(r"(?<![\w@$!|€])(?=[\w@$!|€]*[^\W\d_])[\w@$!|€]*[0134578@$!|€][\w@$!|€]*")
_GAP = re.compile(r"[\W\d_]+")
_ZERO_WIDTH = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_ACCENT = re.compile("[\u0300-\u036f]+")
#: Letters with single marks between them, among them a run of one or two letters, as in i.d.iot; a run is taken
#: whole, also one that ends in a mark, which doesn't count, so that nothing is looked at twice.
_PARTED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]++[.\-_*·])++[^\W\d_]*+")
_MARK = re.compile(r"[.\-_*·]")


def _unmix(found: re.Match) -> str:
    """Signs in letters' places as letters; signs at the end, as in 'no!!', stay."""
    word = found[0]
    body = word.rstrip("!|")
    return body.translate(_SIGN) + word[len(body) :]


def fold(text: str) -> str:
    """Folded words with one space before, between and after them. Words that marks cut into short pieces
    stand once more at the end, in one piece."""
    if not text.isascii():
        text = _ZERO_WIDTH.sub("", _ACCENT.sub("", unicodedata.normalize("NFKD", text)).lower()).translate(_LOOKALIKE)
    else:
        text = text.lower()
    text = _MIXED.sub(_unmix, text)
    whole = [_MARK.sub("", p) for p in _PARTED.findall(text) if p[-1] not in ".-_*·" and min(map(len, _MARK.split(p))) <= 2]
    return f" {' '.join([_GAP.sub(' ', text).strip(), *whole]).strip()} "


class Lexicon:
    """Entries as patterns: ' word ' for a whole word, ' stem' for the beginning of words."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            entry = fold(phrase)
            self.automaton.add_word(entry, (len(entry), None))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, int]:
        """(sum of the weights of matched words, highest weight, words). A word counts once, with its
        heaviest entry; words in an exception phrase don't count."""
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, -math.inf):
                best[start] = weight
        if spared:
            starts, ends = reach(spared)
            best = {s: w for s, w in best.items() if not _within(s, starts, ends)}
        return sum(best.values()), max(best.values(), default=0.0), folded.count(" ") - 1 if folded != "  " else 0


def reach(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts of spans in order, and the furthest end of each and all before it."""
    spans = sorted(spans)
    return [a for a, _ in spans], list(accumulate((b for _, b in spans), max))


def _within(place: int, starts: list[int], ends: list[int]) -> bool:
    at = bisect_right(starts, place) - 1
    return at >= 0 and place < ends[at]


@dataclass
class ToxicityModel:
    """Weights of the lexicon's entries, exception phrases, and the coefficients of the score."""

    weights: dict[str, float]
    exceptions: list[str]
    coefficients: tuple[float, ...]


def inputs(total: float, highest: float, words: int) -> tuple[float, float, float]:
    """What the score is made of: weight per word, damped for short texts, damped total, highest weight."""
    return 10.0 * total / math.sqrt(words + 25.0) / 10.0, math.log1p(max(total, 0.0)), highest


def score(model: ToxicityModel, total: float, highest: float, words: int) -> float:
    """0 to 1, higher: more likely toxic."""
    bias, *slopes = model.coefficients
    z = bias + sum(a * b for a, b in zip(slopes, inputs(total, highest, words), strict=True))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


#: What holds where nothing is labelled: an entry's weight on a short text passes 0.5.
DEFAULT = (-3.0, 1.0, 1.0, 0.5)


def terms(text: str) -> set[str]:
    """Patterns of a text's words: each whole, and the beginnings of the longer ones."""
    found = set()
    for word in set(fold(text).split()):
        found.add(f" {word} ")
        found.update(f" {word[:k]}" for k in STEMS if k < len(word))
    return found


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic documents, other documents) over (text, toxic): counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def full():
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v[1] for v in held.values()]), pa.array([v[0] for v in held.values()])], ["term", "toxic", "clean"])
            held.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in terms(text or ""):
                    held.setdefault(term, [0, 0])[toxic] += 1
                if len(held) > 200_000:
                    yield from full()
        if held:
            yield from full()

    counted = rows.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Entries, weights and score from labelled documents, on about `train_rows` of them.

    Rows whose id has a CRC-32 (as text) divisible by 5 are held out here and nowhere used. Of the
    labelled rows a share is picked by a hash of id and text, equal rows once, so an id with a third of all
    rows is thinned like any other. The weight of an entry is the log-odds of toxic against other
    documents that hold it, smoothed, and it is kept if that stands LEAST_Z standard errors above 0.
    The score is a logistic regression on three figures of each text. Only entries and these
    figures, both bounded by train_rows, come to the driver. Null labels are left out, as are ids with labels of both
    kinds; with no toxic or no other row the built-in list and score remain.
    """
    spark = docs.sparkSession
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(~held_out(F.col("id")) & F.col("toxic").isin(0, 1))
    known = labelled.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = hash_fraction(texts.select("id").join(known.select("id"), "id", "left_semi").count(), train_rows)
    mark = F.xxhash64("id", "text")
    with scratch(spark):
        picked = texts.withColumn("mark", mark).filter(in_hash_sample(F.col("mark"), share)).join(known, "id")
        rows = materialize(picked.dropDuplicates(["mark"]).select("text", "toxic"), "labelled")
        sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        weights = {f" {w} ": SEED_WEIGHT for w in SEED}
        if len(sizes) < 2:
            return ToxicityModel(weights, EXCEPTIONS, DEFAULT)
        odds = F.log((F.col("toxic") + 0.5) / (sizes[1] - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (sizes[0] - F.col("clean") + 0.5))
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        best = _term_counts(rows).filter(F.col("toxic") >= LEAST_DOCS).withColumn("weight", odds).filter(F.col("weight") > LEAST_Z * error)
        weights |= {term: weight for term, (weight, _) in needed({r.term: (r.weight, r.toxic) for r in best.collect()}).items()}
        model = ToxicityModel(weights, EXCEPTIONS, DEFAULT)
        figures = with_features(rows, model, "text").select("toxic", "__dl_f.*").toPandas().sort_values(["toxic", "total", "highest", "words"])
    x = np.array([inputs(*f) for f in figures[["total", "highest", "words"]].itertuples(index=False)])
    return ToxicityModel(weights, EXCEPTIONS, tuple(map(float, logistic(x, figures["toxic"].to_numpy(float)))))


def needed(found: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """The (weight, toxic documents) entries without beginnings that say hardly more than one longer entry."""
    longest: dict[str, int] = {}
    for entry, (_, toxic) in found.items():
        for k in range(1, len(entry)):
            longest[entry[:k]] = max(longest.get(entry[:k], 0), toxic)
    return {e: v for e, v in found.items() if e.endswith(" ") or longest.get(e, 0) < 0.9 * v[1]}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients, bias first, of a ridge logistic regression by Newton's method, on scaled columns."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    design = np.column_stack([np.ones(len(x)), x / scale])
    b = np.zeros(design.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(b)), design.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([b[:1], b[1:] / scale])


def held_out(key: Column) -> Column:
    """True for ids whose CRC-32, as text, is divisible by 5; false for null ids."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _matcher(spark, model: ToxicityModel):
    """A function that gives a worker's lexicon; the model, of bounded size, is sent as a broadcast."""
    import uuid

    sent, key = spark.sparkContext.broadcast(model), ("toxicity", uuid.uuid4().hex)
    return lambda: (kept(key, lambda: Lexicon(sent.value.weights, sent.value.exceptions)), sent.value)


def with_features(rows: DataFrame, model: ToxicityModel, text_col: str) -> DataFrame:
    """The rows with a struct __dl_f of total, highest and words."""
    made = _matcher(rows.sparkSession, model)

    @F.pandas_udf("total double, highest double, words long")
    def features(texts: pd.Series) -> pd.DataFrame:
        lexicon, _ = made()
        return pd.DataFrame([lexicon.features(t or "") for t in texts], columns=["total", "highest", "words"])

    return rows.withColumn("__dl_f", features(F.col(text_col)))


def score_column(spark, model: ToxicityModel, text: Column) -> Column:
    """The toxicity score, 0 to 1, of a text column; a null text counts as empty."""
    made = _matcher(spark, model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        lexicon, sent = made()
        return pd.Series([score(sent, *lexicon.features(t or "")) for t in texts], dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) of each document.

    Null and empty texts hold no entry and get the score of a text without one. Ids may be null
    (not held out) or repeat; every row is scored. Other columns are ignored. An empty table gives
    an empty result. Narrow: no shuffle, whole texts, one document at a time in memory.
    """
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is under the threshold. Null and empty texts have the score of
    a text without an entry; ids aren't looked at, repeated rows stay as they are, an empty table stays empty. Narrow."""
    return docs.filter(score_column(docs.sparkSession, model, F.col(text_col)) < threshold)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
