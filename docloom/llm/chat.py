"""Chat formatting by quotation linking.

Messages quote earlier ones in lines that begin with >, nested to any depth. Quoted passages are
hashed in a normalised form and joined to the messages that said them first; the links order each
conversation by replies, and the messages are rendered without what they quote. Lines that begin with > but
quote no known message, as prompts of a shell do, stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES
from .common import global_rank, materialize, scratch

_QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.DOTALL)
#: A line that introduces a quote, as mail programs write it, without its colon: dropped if a quote follows.
_SAID = re.compile(r"(?i)on\b.*\bwrote$|am\b.*?\bschrieb\b|le\b.*\ba écrit$|el\b.*\bescribió$|.+\b(?:wrote|said|writes)$")
_SPACE = re.compile(r"\s+")

_SENTENCE = re.compile(r"(?<=[.!?])\s+")

PARSED = "conv_id long, turn long, role string, n_quotes int, segments array<struct<text:string,places:array<int>>>, own array<long>, pieces array<struct<level:int,place:int,hash:long,length:int>>"


def introduces(line: str) -> bool:
    """True for a line that ends with a colon and says who wrote what follows."""
    line = line.strip()
    return line.endswith(":") and bool(_SAID.match(line[:-1].rstrip()))


def normal(text: str) -> str:
    """What survives re-wrapping and re-typing: case-folded words with single spaces."""
    return _SPACE.sub(" ", text).strip().casefold()


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Runs of lines that aren't blank."""
    found, held = [], []
    for line in [*lines, ""]:
        if line.strip():
            held.append(line)
        elif held:
            found.append(held)
            held = []
    return found


def passages(lines: list[str]) -> list[str]:
    """Normalised paragraphs of a run of lines and, if there are several, the whole; no empty ones."""
    found = [normal(" ".join(p)) for p in paragraphs(lines)]
    return found + [normal(" ".join(lines))] * (len(found) > 1)


def pieces(paragraph: list[str]) -> list[str]:
    """Normalised lines and sentences of a paragraph: what a trimmed quote may keep of it, wrapped as it was or not."""
    found = [normal(line) for line in paragraph] + _SENTENCE.split(normal(" ".join(paragraph)))
    return [p for p in dict.fromkeys(found) if p]


def parse_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(text without quotes, [(level, normalised passage)]) in order. Level 1 is what the message
    itself quotes, level 2 what the quoted message quoted, and so on. A line of deeper level ends
    a passage; a > that follows text in a line is no quote."""
    segments, quotes, _ = _parse(text)
    own = [t for t, places in segments if not places]
    return tidy("\n".join(own)) if quotes else text, quotes


def tidy(body: str) -> str:
    """What is left of a message without white space at its ends or more than one blank line on end."""
    return re.sub(r"\n{3,}", "\n\n", body).strip()


def _parse(text: str) -> tuple[list[tuple[str, list[int]]], list[tuple[int, str]], list[list[str]]]:
    """(segments, quotes, pieces of each quote). Segments are runs of lines as they stand, with the places in the list of
    quotes that a run of quoted lines has: it goes if one of them has an origin. Own lines have none."""
    if ">" not in text:
        return [(text, [])], [], []
    segments: list[tuple[str, list[int]]] = []
    quotes: list[tuple[int, str]] = []
    parts: list[list[str]] = []
    own: list[str] = []
    held: list[tuple[str, str]] = []  # quoted lines as they stand, and without their signs
    level = 0

    def close_own() -> None:
        if own:
            segments.append(("\n".join(own), []))
            own.clear()

    def close() -> None:
        if not level:
            return
        bare = [b for _, b in held]
        runs, first = paragraphs(bare), len(quotes)
        quotes.extend((level, p) for p in passages(bare))
        parts.extend(pieces(p) for p in runs)
        parts.extend([] for _ in range(len(quotes) - len(parts)))
        places = list(range(first, len(quotes)))
        # The line before the quote, with no more than blanks between, may introduce it.
        end = len(own)
        while end and not own[end - 1].strip():
            end -= 1
        said = own[end - 1 :] if end and runs and introduces(own[end - 1]) else []
        del own[len(own) - len(said) :]
        close_own()
        if said:
            segments.append(("\n".join(said), places))
        # Each quoted paragraph, with the blank lines behind it, is a segment.
        lines: list[list[str]] = [[] for _ in runs] or [[]]
        at, blank = -1, True
        for line, b in held:
            at += blank and bool(b.strip())
            blank = not b.strip()
            lines[max(at, 0)].append(line)
        segments.extend(("\n".join(x), [first + i, *places[len(runs) :]] if runs else []) for i, x in enumerate(lines))
        held.clear()

    for line in text.split("\n"):
        m = _QUOTE.match(line)
        depth = m[1].count(">") if m else 0
        if depth != level:
            close()
            level = depth
        if depth:
            held.append((line, m[2]))
        else:
            own.append(line)
    close()
    close_own()
    return segments, quotes, parts


def _hash(passage: str) -> int:
    import xxhash

    n = xxhash.xxh64_intdigest(passage)
    return n - (1 << 64) if n >> 63 else n


def parse_messages(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each message's segments, the hashes of its own passages and pieces and those of its quotes. Narrow."""
    piece = pa.struct([("level", pa.int32()), ("place", pa.int32()), ("hash", pa.int64()), ("length", pa.int32())])
    segment = pa.struct([("text", pa.string()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shown, owns, kept = [], [], [], []
            for t in batch.column(3).to_pylist():
                segments, quotes, parts = _parse(t or "")
                counts.append(len(quotes))
                shown.append([{"text": x, "places": places} for x, places in segments])
                lines = "\n".join(x for x, places in segments if not places).split("\n")
                owns.append(sorted({_hash(p) for p in [*passages(lines), *(x for held in paragraphs(lines) for x in pieces(held))]}))
                kept.append([{"level": level, "place": i, "hash": _hash(x), "length": len(x)} for i, (level, p) in enumerate(quotes) for x in dict.fromkeys([p, *parts[i]])])
            columns = [pa.array(counts, pa.int32()), pa.array(shown, pa.list_(segment)), pa.array(owns, pa.list_(pa.int64())), pa.array(kept, pa.list_(piece))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["conv_id", "turn", "role", "n_quotes", "segments", "own", "pieces"])

    chosen = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, PARSED)


def quote_links(parsed: DataFrame) -> DataFrame:
    """(row, conv_id, turn, level, place, from_conv, from_turn) of every quoted passage whose origin is known.

    The origin is the first message of the same conversation, before the quoting one, that says the
    passage itself; else the first of any other conversation. Of a passage that nobody says whole, the
    longest line or sentence with an origin counts, as of a trimmed quote. Passages that nobody quotes drop out
    by a semi join, and the rest are reduced with map-side minima by hash, so a passage that
    thousands of messages share is one row before it meets its quotes.
    """
    at = ["row", "conv_id", "turn"]
    quoted = materialize(parsed.filter("n_quotes > 0").select(*at, F.explode("pieces").alias("q")).select(*at, "q.*"), "quotes")
    said = parsed.select("conv_id", "turn", F.explode("own").alias("hash")).join(quoted.select("hash").distinct(), "hash", "left_semi")
    near = materialize(said.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn")), "said")
    # The first two conversations of each passage: one of them is another than the quoting one.
    firsts = near.groupBy("hash").agg(F.min(F.struct("conv_id", "near_turn")).alias("first"))
    others = near.join(firsts, "hash").filter("conv_id != first.conv_id").groupBy("hash").agg(F.min(F.struct("conv_id", "near_turn")).alias("second"))
    linked = quoted.join(near, ["hash", "conv_id"], "left").join(firsts, "hash", "left").join(others, "hash", "left")
    inside = F.col("near_turn") < F.col("turn")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    origin = F.when(inside, F.struct(F.col("conv_id"), F.col("near_turn"))).otherwise(other)
    whole = F.min(F.struct(-F.col("length"), "hash", "o")).alias("best")
    chosen = linked.withColumn("o", origin).filter("o is not null").groupBy(*at, "level", "place").agg(whole).withColumn("o", F.col("best.o"))
    return chosen.select(*at, "level", "place", F.col("o.conv_id").alias("from_conv"), F.col("o.near_turn").alias("from_turn"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of replies (conv_id, turn, parent): the turn that starts the
    thread and the number of replies from it, by pointer doubling. A parent's turn is lower than
    its reply's, so there are no rings; rounds are the logarithm of the longest chain."""
    now = materialize(replies.withColumn("depth", F.lit(1)).withColumnRenamed("parent", "thread"), "threads")
    while True:
        now_rows = now.drop("moved")
        up = now_rows.select(F.col("conv_id"), F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        stepped = materialize(now_rows.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "threads", instead_of=now)
        if not stepped.filter("moved").limit(1).count():
            return stepped.drop("moved")
        now = stepped


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages without what they quote, in reply order: (conv_id, turn, role, body, reply_to, thread, depth, n_quotes, n_linked, other_conv, seq, chat).

    reply_to is the turn that the message quotes at its lowest level first, null if it quotes none
    of its conversation; thread is the turn at the root of its replies. Sorted by seq, a
    conversation's threads follow each other and each message comes after what it replies to;
    chat is the message in chat markup, so a conversation is its chats in that order. other_conv is
    the conversation a quote came from if it isn't this one. A quoted paragraph, and the line that
    introduces it, is left out of the body if its origin is known; others stay as they stand.

    A null text is empty; a null role is "user". Messages with a null conversation or turn are kept,
    quote nothing and are nobody's origin. Repeated turns are kept as they stand, each without its own linked
    quotes; as origins, and in what they reply to, they are one. Other columns are ignored; an empty table gives an empty result. No
    conversation is ever gathered: links are minima, threads joins, and seq is a range-partitioned rank.
    The tables between go when the result, a table too, is written.
    """
    with scratch(messages.sparkSession):
        return materialize(_formatted(messages, conv, turn, role, text), "chats", keep=True)


def _formatted(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    parsed = materialize(parse_messages(messages, conv, turn, role, text).withColumn("row", F.monotonically_increasing_id()), "messages")
    keyed = parsed.filter("conv_id is not null and turn is not null")
    links = materialize(quote_links(keyed), "quote-links")
    at = ["conv_id", "turn"]
    own = F.when(F.col("from_conv") == F.col("conv_id"), F.struct("level", "place", "from_turn"))
    other = F.when(F.col("from_conv") != F.col("conv_id"), F.struct("level", "place", "from_conv"))
    found = materialize(links.groupBy(*at).agg(F.min(own).alias("own"), F.min(other).alias("other")).select(*at, F.col("own.from_turn").alias("reply_to"), F.col("other.from_conv").alias("other_conv")), "replies")
    rooted = threads(found.filter("reply_to is not null").select(*at, F.col("reply_to").alias("parent")))
    # As many places as the message has quotes.
    linked = links.groupBy("row").agg(F.collect_set("place").alias("linked"))
    full = parsed.join(linked, "row", "left").join(found, at, "left").join(rooted, at, "left")
    stays = F.filter("segments", lambda s: ~F.coalesce(F.arrays_overlap(s["places"], F.col("linked")), F.lit(False)))
    left = F.array_join(F.transform(stays, lambda s: s["text"]), "\n")
    body = F.when(F.size(stays) < F.size("segments"), F.btrim(F.regexp_replace(left, "\n{3,}", "\n\n"), F.lit(SPACES))).otherwise(left)
    shown = full.withColumn("body", body).select(
        *at,
        "role",
        "body",
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("n_quotes").cast("long").alias("n_quotes"),
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"),
        "other_conv",
        F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"), F.col("body"), F.lit("<|im_end|>\n")).alias("chat"),
        "row",
    )
    return global_rank(shown, [F.col(c) for c in ("conv_id", "thread", "turn", "role", "body", "row")], "seq").drop("row")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, linked by their quotes and in reply order."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
