"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of m words may be found with up to k = floor(m * tolerance) word edits (insertions,
deletions, replacements). Cut into k + 1 pieces, at least one piece must stand in the document
unchanged; all pieces of all items are found at once, by a hash of each run of words that is as long as
some piece, and only the stretch of the document around a hit is checked, by Myers' bit-parallel edit
distance over whole words, so that hashes decide nothing.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize

#: Share of an item's words that may differ (a similarity of 0.8 or more), and bytes of item text that one pass over the documents takes.
TOLERANCE, BLOCK_BYTES = 0.2, 16_000_000
#: Blocks whose matchers (about 63 MB each) a worker keeps at once.
TOGETHER = 3

#: Bits of the map that tells whether some piece has such a hash, and items whose masks a worker keeps.
MAP_BITS, MASKS = 22, 1024

_NO_WORD = re.compile(r"[\W_]+")
#: Letters of scripts that are written without spaces; each is a word. Thai to Lao, Burmese, Khmer, Kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f])")
_STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; in scripts without spaces each letter."""
    low = text.lower()
    if not low.isascii():
        low = _UNSPACED.sub(r" \1 ", low)
    return _NO_WORD.sub(" ", low).split()


def edges(n: int, budget: int) -> list[int]:
    """Where the budget + 1 pieces of n words begin, and n: as even as can be."""
    parts = budget + 1
    return [n * i // parts for i in range(parts + 1)]


def grams(words: list[str], longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of each run of that many words) for lengths up to `longest`; hashes hold within one process."""
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    run = one
    for k in range(1, min(longest, len(words)) + 1):
        if k > 1:
            run = run[:-1] * _STEP + one[k - 1 :]
        yield k, run * _LAST


def best_place(masks: dict[str, int], m: int, window: list[str]) -> tuple[int, int]:
    """(edit distance, last word) of the closest place of an m-word pattern in the window, by Myers'
    bit-parallel rule; masks has for each word the pattern positions at which it stands."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for at, word in enumerate(window):
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(xv | up)), up & xv
        if score < best[0]:
            best = (score, at)
    return best


class Matcher:
    """The pieces of a block of items, ready to be looked for: for each length in words sorted hashes with
    items and offsets, a few bytes a word of the items."""

    def __init__(self, items: list[tuple[object, str]], tolerance: float) -> None:
        self.items, found = [], defaultdict(list)
        for number, text in items:
            words = words_of(text or "")
            if not words:
                continue
            budget = int(len(words) * tolerance)
            at = np.array(edges(len(words), budget))
            sizes = at[1:] - at[:-1]
            for k, hashes in grams(words, int(sizes.max())):
                starts = at[:-1][sizes == k]
                if len(starts):
                    found[k].append((hashes[starts], np.full(len(starts), len(self.items)), starts))
            self.items.append((number, text, len(words), budget))
        self.pieces = {}
        for k, parts in found.items():
            hashes, owner, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            there = np.zeros(1 << MAP_BITS, np.bool_)
            there[hashes >> np.uint64(64 - MAP_BITS)] = True
            self.pieces[k] = (there, hashes[order], owner[order].astype(np.int32), offset[order].astype(np.int32))
        self.longest = max(self.pieces, default=0)
        self.masks = lru_cache(MASKS)(self._masks)

    def _masks(self, item: int) -> dict[str, int]:
        """For each word of an item the places at which it stands, as bits."""
        masks: dict[str, int] = defaultdict(int)
        for i, w in enumerate(words_of(self.items[item][1])):
            masks[w] |= 1 << i
        return dict(masks)

    def hits(self, words: list[str]) -> dict[int, list[tuple[np.ndarray, int]]]:
        """For each item with a piece in the text the places of its pieces there, with the piece's offset in the item.

        Equal pieces of many items share one array of places, so memory grows with the places and the items, not with their product.
        """
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k, run in grams(words, self.longest):
            if k not in self.pieces:
                continue
            there, hashes, owner, offset = self.pieces[k]
            at = np.flatnonzero(there[run >> np.uint64(64 - MAP_BITS)])
            low, high = np.searchsorted(hashes, run[at]), np.searchsorted(hashes, run[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            order = np.argsort(low, kind="stable")
            at, low, high = at[order], low[order], high[order]
            cuts = np.flatnonzero(np.diff(low, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                for i in range(low[a], high[a]):
                    found[int(owner[i])].append((at[a:b], int(offset[i])))
        return found

    def find(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item, distance, budget, first word of the stretch, item words) for each item found in the text, its best place only."""
        if not self.pieces:
            return []
        words = words_of(text)
        found, there = [], None
        for item, pieces in sorted(self.hits(words).items()):
            number, _, m, budget = self.items[item]
            there = set(words) if there is None else there
            # Each word of the item that the text doesn't have at all is an edit.
            if sum(bits.bit_count() for w, bits in self.masks(item).items() if w not in there) > budget:
                continue
            begins, best = np.unique(np.concatenate([at - offset for at, offset in pieces])), None
            for a, b in merged(begins - budget, begins + m + budget):
                a = max(a, 0)
                distance, last = best_place(self.masks(item), m, words[a:b])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, a + max(last - m + 1, 0))
                    if not distance:
                        break
            if best:
                found.append((number, best[0], budget, best[1], m))
        return found


def merged(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Overlapping spans, in order of their starts and of one length, as one."""
    cuts = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return zip(starts[np.concatenate([[0], cuts])].tolist(), ends[np.concatenate([cuts - 1, [len(ends) - 1]])].tolist(), strict=True)


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The test items in lists of bounded size; the driver holds one partition and one list at a time."""
    held, size = [], 0
    for number, text in items.select(id_col, text_col).toLocalIterator():
        more = len((text or "").encode())
        if held and size + more > block_bytes:
            yield held
            held, size = [], 0
        held.append((number, text))
        size += more
    if held:
        yield held


def _matchers(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, tolerance: float, block_bytes: int) -> list:
    """For each block of items, a function that gives a worker's matcher. The block is sent as a broadcast of bounded size."""
    made = []
    for block in blocks(items, item_id, item_text, block_bytes):
        sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
        made.append(lambda sent=sent, key=key: _held(key, lambda: Matcher(sent.value, tolerance)))
    return made


#: Matchers that a worker keeps, the latest used last.
_MATCHERS: dict[str, Matcher] = {}


def _held(key: str, make: Callable[[], Matcher]) -> Matcher:
    """A worker's matcher of a block; it keeps those of TOGETHER blocks."""
    found = _MATCHERS.pop(key, None)
    if found is None:
        while len(_MATCHERS) >= TOGETHER:
            del _MATCHERS[next(iter(_MATCHERS))]
        found = make()
    _MATCHERS[key] = found
    return found


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and test item found in it: (id, item_id, distance, budget, start_word, item_words).

    Words are runs of letters and digits of the lower-cased text, and single letters in scripts without spaces. Items of fewer than 1/tolerance
    words have no error budget and are looked for as they are; items without words match nothing.
    Of several places of an item in a document the closest, then the first, counts.

    The items are a query set: they go over all documents in blocks of bounded size, one pass a
    block, so neither driver nor executors hold more than a block however many items there are. No
    shuffle; only hits leave a task. Null texts count as empty; ids may be null or repeat, each row
    is looked at. Equal items are found under each of their ids. Other columns are ignored. An
    empty table on either side gives an empty result.
    """
    number = items.schema[item_id].dataType
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", number), *(T.StructField(c, T.LongType()) for c in ("distance", "budget", "start_word", "item_words"))])

    item_type = to_arrow_type(number)

    def scan(matcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = matcher()
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for hit in match.find(t)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], item_type), *(pa.array(c, pa.int64()) for c in columns[2:])], schema.fieldNames())

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    made = [scan(m) for m in _matchers(docs, items, item_id, item_text, tolerance, block_bytes)]
    return reduce(DataFrame.union, made) if made else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, in which no test item is found; null and empty texts stay.

    One narrow filter for each TOGETHER blocks of items; between such filters the documents left are a table, so a
    worker never holds more matchers at once.
    """
    def clean(matchers):
        @F.pandas_udf("boolean")
        def holds(texts: pd.Series) -> pd.Series:
            fine = np.ones(len(texts), np.bool_)
            for matcher in matchers:
                match = matcher()
                fine[fine] = [not match.find(t or "") for t in texts[fine]]
            return pd.Series(fine)

        return holds(F.col(text_col))

    made = _matchers(docs, items, item_id, item_text, tolerance, block_bytes)
    for i in range(0, len(made), TOGETHER):
        docs = (materialize(docs, "without-leaks") if i else docs).filter(clean(made[i : i + TOGETHER]))
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All benchmark items found in all documents."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
