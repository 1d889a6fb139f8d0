"""Token counts and token-ID files for byte-level BPE tokenizers of the tokenizers library.

A text is cut at every single space that follows a non-space character. The byte-level
pre-tokenizer always starts a new pre-token there, and special tokens hold no white space, so the
tokens of the pieces, each taken with its space, are the tokens of the text. Pieces repeat, so what
the library gives for a piece is kept in a table of bounded size in each Python worker.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a worker's table of pieces takes before it starts anew (the older generation stays beside it),
#: and characters of the longest piece that it keeps; longer ones hardly ever come back.
TABLE_BYTES, LONGEST = 112 << 20, 48

_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def pieces(text: str) -> list[str]:
    """The text cut before each space that follows a non-space; all but the first piece have lost that space."""
    return _CUT.split(text) if _AFTER_SPACE.search(text) else text.split(" ")


def load_tokenizer(definition: str):
    """The tokenizer of a JSON definition. It must split by the byte-level rule without normalising,
    as only then are pieces independent of each other."""
    import json

    from tokenizers import Tokenizer

    said = json.loads(definition)
    rule = said.get("pre_tokenizer") or {}
    if said.get("normalizer") or rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex", True):
        raise ValueError("only byte-level tokenizers without normalizer or prefix space are supported")
    if any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in said.get("added_tokens", ())):
        raise ValueError("added tokens must not hold or take in white space")
    return Tokenizer.from_str(definition)


def read_definition(path: str) -> str:
    """The JSON definition, read once on the driver and sent to the executors; its size is that of one vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_whole(tokenizer) -> frozenset[str]:
    """Vocabulary strings, in the byte-level alphabet, of which the library itself shows that the
    string alone encodes as exactly that one token. Merging depends on nothing outside the
    pre-token, so an equal pre-token is one token in any text."""
    alphabet = byte_alphabet()
    found = []
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if not all(c in alphabet for c in token):
            continue
        try:
            text = bytes(alphabet[c] for c in token).decode("utf-8")
        except UnicodeDecodeError:
            continue
        found.append((token, number, text))
    encoded = tokenizer.encode_batch([text for _, _, text in found], add_special_tokens=False)
    return frozenset(token for (token, number, _), e in zip(found, encoded, strict=True) if e.ids == [number])


@lru_cache(2)
def proven(definition: str) -> frozenset[str]:
    """proven_whole() of a definition, worked out once in the life of a driver."""
    return proven_whole(load_tokenizer(definition))


class Bounded(dict):
    """piece -> value, computed when missing. When it takes `most` bytes it becomes the older generation and
    starts anew; what is still used is carried over. Long pieces, and those of several lines, are computed each time."""

    def __init__(self, compute, most: int) -> None:
        super().__init__()
        self.compute, self.most, self.taken, self.old = compute, most, 0, {}

    def __missing__(self, key: str):
        if len(key) > LONGEST:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if "\n" in key and len(key) > 2:
            return value  # made of lines, which are kept
        # Key, value and the dictionary's own slot: ids take 2 to 4 bytes for at most one a byte, long letters 2.
        size = 160 + 4 * len(key)
        if self.taken + size > self.most:
            self.old = dict(self)
            self.clear()
            self.taken = 0
        self.taken += size
        self[key] = value
        return value


#: What the byte-level rule splits by, as the library states it; only used on code points below
#: U+0250, whose classes all versions of Unicode share. Others go through the library's own splitter.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile(r"[^\x20-\x7e\n\t\u00a1-\u024f]")


#: Signs that stand together as one pre-token behind a word. No apostrophe, which may begin another,
#: and no sign of a special token.
_SIGNS = '.,;:!?|%&$*#"()[]{}'


class Splitter:
    """Cuts a piece into pre-tokens, and writes a pre-token in the byte-level alphabet."""

    def __init__(self, tokenizer) -> None:
        import regex

        self.pre_tokenizer, self.find = tokenizer.pre_tokenizer, regex.compile(_RULE).findall
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.table = {b: c for c, b in byte_alphabet().items()}
        self.space = self.table[ord(" ")]

    def words(self, piece: str) -> list[str] | None:
        """The pre-tokens; None if the piece holds a special token."""
        for s in self.special:
            if s in piece:
                return None
        if _OTHER.search(piece):
            return [piece[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(piece)]
        return self.find(piece)

    def spelled(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.space)
        return word.encode().decode("latin-1").translate(self.table)


class Worker:
    """What texts are made of, summed over their pieces: a base of Counter and Encoder."""

    def __init__(self, definition: str) -> None:
        self.tokenizer = load_tokenizer(definition)
        self.splitter = Splitter(self.tokenizer)
        self.tokenize = self.tokenizer.model.tokenize
        # Whether no special token can be made of letters and those signs.
        self.plain = not any(all(c.isalpha() or c in _SIGNS for c in s) for s in self.splitter.special)
        self.spaced = Bounded(self.after_space, TABLE_BYTES)
        self.bare = Bounded(self.without_space, TABLE_BYTES // 4)

    def after_space(self, rest: str):
        """The piece that is a space and `rest`. Most are letters, perhaps with signs behind them: one
        pre-token, or two. A lone line break between other characters is a pre-token of its own."""
        if "\n" in rest:
            lines = rest.split("\n")
            if all(lines) and not self.space_at_ends(lines):
                first, *others = lines
                return self.add([self.spaced[first], *(x for line in others for x in (self.bare["\n"], self.bare[line]))])
        elif self.plain and not _OTHER.search(rest):
            if rest.isalpha():
                return self.word(" " + rest)
            word = rest.rstrip(_SIGNS)
            if word.isalpha():
                return self.add([self.spaced[word], self.bare[rest[len(word) :]]])
        return self.piece(" " + rest)

    @staticmethod
    def space_at_ends(lines: list[str]) -> bool:
        """Whether some line begins or ends with white space, which the line break would then join."""
        return any(line[0].isspace() or line[-1].isspace() for line in lines)

    def without_space(self, piece: str):
        """A piece as it stands: a pre-token, or a line of several."""
        if self.plain and not _OTHER.search(piece):
            word = piece.rstrip(_SIGNS)
            if word.isalpha():
                return self.add([self.bare[word], self.bare[piece[len(word) :]]]) if len(word) < len(piece) else self.word(piece)
        return self.piece(piece)

    def piece(self, piece: str):
        words = self.splitter.words(piece)
        if words is None:
            return self.whole_piece(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(words) == 1:
            return self.word(words[0])
        return self.add([self.spaced[w[1:]] if w[0] == " " else self.bare[w] for w in words])

    def text(self, text: str):
        first, *rest = pieces(text)
        return self.add([self.bare[first], *map(self.spaced.__getitem__, rest)])


class Counter(Worker):
    """Counts the tokens of texts in one worker."""

    add, whole_piece = staticmethod(sum), staticmethod(len)

    def __init__(self, definition: str, whole: frozenset[str]) -> None:
        super().__init__(definition)
        alphabet = byte_alphabet()
        self.whole = frozenset(bytes(alphabet[c] for c in token).decode() for token in whole)

    def word(self, word: str) -> int:
        return 1 if word in self.whole else len(self.tokenize(self.splitter.spelled(word)))


class Encoder(Worker):
    """Gives texts' ids as little-endian bytes of `width` bytes an id in one worker."""

    add = staticmethod(b"".join)

    def __init__(self, definition: str, width: int) -> None:
        import numpy as np

        super().__init__(definition)
        self.dtype, self.code = np.dtype(f"<u{width}"), "H" if width == 2 else "I"
        self.packs = [struct.Struct(f"<{n}{self.code}").pack for n in range(32)]

    def whole_piece(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def word(self, word: str) -> bytes:
        return self.whole_piece([t.id for t in self.tokenize(self.splitter.spelled(word))])


#: What a Python worker keeps between its tasks, by the tokenizer's hash; one entry.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def count_tokens(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of each whole text: (id, n_bytes, n_tokens, over_limit).

    The vocabulary strings that encode alone as one token are proven on the driver beforehand;
    pre-tokens equal to one count 1, only the others are merged. Special strings inside a text are
    tokens, as the library has it by default; nothing is added, cut or padded.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Ids may be null or repeat:
    each row gives a row. Other columns are ignored. An empty table gives an empty result. Narrow:
    no shuffle; a text is held whole by the worker that counts it, nothing else grows with the data.
    """
    import hashlib

    sent = docs.sparkSession.sparkContext.broadcast((definition, proven(definition)))
    key = ("count", hashlib.sha256(definition.encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = kept(key, lambda: Counter(*sent.value))
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts = [counter.text(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, read_definition(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "n_bytes", "n_tokens", "over_limit")
