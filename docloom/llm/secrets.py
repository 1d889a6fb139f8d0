"""Secret scan: fixed patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer reads a text into (name, literal) pairs. Names are bound by `name = literal`, `name: literal`,
`"name" => literal`, `name["key"] = literal`, `name.set("key", literal)`, `name(literal)`, `"name", literal`,
`<name>literal</name>`, `--name literal`, `#define name literal` and YAML blocks and lists (`name: |`).
Literals are quoted, also three times, bare, or lines of a block; quoted ones may be joined by +, a dot or
nothing at all. A bare word on the right that is the name of a constant, an earlier one or else the first
later one, stands for that constant, through any number of steps. A value, its parts joined, is
reported part by part when a name that it reaches, the one it is bound to or one that it is passed on
to, is sensitive, and the name's weight and the value's own look together reach a threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which equal starts are listed; the last is the lexer's.
KINDS = ("assign", "access", "hex", "literal")

# The patterns of the three basic kinds, with the least length of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A run of that many hex digits or more; the same matches as HEX with the shorter ones dropped.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Parts of names and how far each makes a literal suspect.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "authorization": 2.0, "bearer": 2.5, "private": 1.5, "signing": 1.5, "encryption": 1.5, "access": 1.0, "key": 1.0, "salt": 1.5, "cookie": 1.0, "session": 1.0, "dsn": 1.5}
MILD = {"public": -2.0, "example": -2.0, "sample": -2.0, "placeholder": -3.0, "hash": -0.5, "id": -0.5, "name": -1.5, "url": -1.0, "path": -1.5, "file": -1.5, "length": -3.0, "type": -2.0, "count": -3.0}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|(?:your|my|the|some)[-_ ].*|change[-_]?me.*|(?:todo|none|null|nil|true|false|undefined|example|placeholder|password|secret|token|test|dummy|redacted)\d*)$")

# Names and other runs are taken whole (possessive), so no text makes the lexer go back over it.
_NAME = r"[A-Za-z_$][\w$.-]*+"
_BIND = re.compile(
    rf"""
    (?P<define>\#define[ \t]+)(?P<n1>{_NAME})[ \t]+(?=\S)
  | (?P<flag>(?<![\w-])--)(?P<n2>[A-Za-z][\w-]*+)(?:[ \t]+|=)(?=["'A-Za-z0-9+/_])
  | <(?P<n3>[A-Za-z_][\w.-]*+)>(?=[^<>\s])
  | (?P<quote>["']?)(?<![\w$.-])(?P<n4>{_NAME})(?P=quote)(?:[ \t]*\])?+(?:\[[^\[\]\n"']*+\])*+[ \t]*+
    (?: (?: :[ \t]*+[\w.\[\]<>,\ ]++= | := | => | : | = )(?![=>:/])[ \t]*+(?:\([ \t]*+\n?[ \t]*+(?=["']))?+
      | [(,][ \t]*+(?=["']) )
    """,
    re.ASCII | re.VERBOSE,
)
_TRIPLE = re.compile(r"""(?:[rbuf]{0,2})(\"{3}|'{3})""", re.ASCII)
_QUOTED = re.compile(r"""(?:[rbuf]{0,2})("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)""", re.ASCII)
#: A bare literal; = only as padding at its end, so that chains of assignments give short literals.
_BARE = re.compile(r"[A-Za-z0-9+/_.@%~^&*!?$-]++={0,2}", re.ASCII)
#: What may stand between the parts of one value: an operator, a line's end behind a backslash, or nothing but space.
_JOIN = re.compile(r"(?:[ \t]*+(?:\+|\.)|[ \t]*+\\)?[ \t]*+(?:\n[ \t]*+)?(?=[rbuf]{0,2}[\"'])")
#: The head of a YAML block (|, >, with signs); how lines end that have a block, or a list, below; the dashes of a list's lines.
_BLOCK = re.compile(r"[|>][+\-0-9]*+[ \t]*+(?=\n)")
_HEADS_BLOCK = re.compile(r"(?::[ \t]*+|=[ \t]++)[|>][+\-0-9]*+$")
_DASHES = re.compile(r"(?:-[ \t]++)*+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_IDENTIFIER = re.compile(rf"{_NAME}$", re.ASCII)
#: A literal is reported from this score on.
THRESHOLD, LEAST_LITERAL = 4.0, 8
_OPERATOR = re.compile(r"""[=:]|--[A-Za-z]|#define|</|[(,][ \t]*+["']""")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three basic kinds: leftmost non-overlapping matches, short ones dropped."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    """How sensitive a name is: the sum over its parts, camel case and separators apart."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    parts = [p[:-1] if p[:-1] in SENSITIVE and p not in SENSITIVE else p for p in parts]  # tokens, keys
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    strong = sum(SENSITIVE.get(p, 0.0) for p in parts) + sum(SENSITIVE.get(p, 0.0) for p in pairs if p not in parts)
    return strong + (sum(MILD.get(p, 0.0) for p in parts) if strong else 0.0)


def literal_weight(value: str) -> float:
    """How far a literal looks like a secret: bits of entropy a character, kinds of characters, length; below 0 for placeholders, prose and plain numbers."""
    if len(value) < LEAST_LITERAL or PLACEHOLDER.match(value) or " " in value.strip():
        return -10.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    if kinds < 2 and len(value) < 20:
        return -1.0
    return max(0.0, entropy - 2.0) + 0.5 * (kinds - 1) + (0.5 if len(value) >= 20 else 0.0)


Part = tuple[int, int, str]


def _quoted(text: str, at: int) -> tuple[list[Part], int]:
    """Quoted literals from there on that make one value, and where they end."""
    parts: list[Part] = []
    while True:
        if t := _TRIPLE.match(text, at):
            end = text.find(t[1], t.end())
            if end < 0:
                return parts, at
            parts.append((t.end(), end, text[t.end() : end]))
            at = end + 3
        elif q := _QUOTED.match(text, at):
            parts.append((q.start(1) + 1, q.end(1) - 1, q[1][1:-1]))
            at = q.end()
        else:
            return parts, at
        if not (more := _JOIN.match(text, at)):
            return parts, at
        at = more.end()


def _blocks(text: str) -> dict[int, list[list[Part]]]:
    """Values of the lines below a key, by the end of the key's line: one of all lines of a block, or of a list one a line.

    Lines are walked once, with the lists that are open above them in a stack. A line of a block is indented further
    than its key and belongs to nothing else; a line of a list belongs to the innermost key that isn't indented
    further, a key behind a dash being as far in as its name. Every other line ends the lists.
    """
    found: dict[int, list[list[Part]]] = {}
    lists: list[tuple[int, int]] = []
    block: tuple[int, int] | None = None
    start = 0
    for line in text.split("\n"):
        end = start + len(line)
        body = line.strip()
        if body:
            at = start + line.index(body)
            indent = len(line) - len(line.lstrip(" \t"))
            if block and indent > block[0]:
                found[block[1]][0].append((at, at + len(body), body))
            else:
                block = None
                dashes = _DASHES.match(line, indent).end() - indent
                value = line[indent + dashes :].strip()
                if not dashes or not value:
                    lists = []
                while lists and indent < lists[-1][0]:
                    lists.pop()
                if lists:
                    at = start + line.index(value, indent + dashes)
                    quoted = _QUOTED.match(text, at)
                    found[lists[-1][1]].append([(at + 1, quoted.end(1) - 1, quoted[1][1:-1])] if quoted and quoted.start(1) == at else [(at, at + len(value), value)])
                if body.endswith(":"):
                    lists.append((indent + dashes, end))
                    found[end] = []
                elif _HEADS_BLOCK.search(body[-12:]):
                    block = (indent + dashes, end)
                    found[end] = [[]]
        start = end + 1
    return found


def bindings(text: str) -> Iterator[tuple[str, list[Part], str | None]]:
    """(name, parts of its value as (start, end, text), name on the right) of each assignment, in order."""
    blocks: dict[int, list[list[Part]]] | None = None
    for m in _BIND.finditer(text):
        name, at = m["n1"] or m["n2"] or m["n3"] or m["n4"], m.end()
        parts, _ = _quoted(text, at)
        if parts:
            yield name, parts, None
        elif text[at - 1] in ",(":
            continue
        elif m["n4"] and ((head := _BLOCK.match(text, at)) and text[at - 1 : at] in ":\t " or text[at : at + 1] == "\n" and ":" in m[0]):
            blocks = _blocks(text) if blocks is None else blocks
            for value in blocks.get(head.end() if head else at, []):
                if value:
                    yield name, value, None
        elif bare := _BARE.match(text, at):
            value = bare[0].rstrip(".!?")
            if value:
                yield name, [(bare.start(), bare.start() + len(value), value)], value if _IDENTIFIER.match(value) else None


class _Values:
    """Values and the names that they reach: a name that stands for another's value joins it (union-find),
    and a value keeps the heaviest weight of its names, however many there are."""

    def __init__(self) -> None:
        self.up: list[int] = []
        self.weight: list[float] = []

    def new(self, weight: float) -> int:
        self.up.append(len(self.up))
        self.weight.append(weight)
        return len(self.up) - 1

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[i] = j
            self.weight[j] = max(self.weight[i], self.weight[j])


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(start, end, "literal") of the parts of values that reach a sensitive name."""
    if not _OPERATOR.search(text):
        return []
    values, held = _Values(), []
    now: dict[str, int] = {}
    first: dict[str, int] = {}
    waiting: list[tuple[int, str]] = []
    for name, parts, right in bindings(text):
        i = values.new(name_weight(name))
        if right is not None and right in now:
            values.join(i, now[right])
        else:
            held.append((i, parts))
            if right is not None:
                waiting.append((i, right))
        now[name] = i
        first.setdefault(name, i)
    names = set()
    for i, right in waiting:
        if right in first and values.root(first[right]) != values.root(i):
            values.join(i, first[right])
            names.add(i)
    found = set()
    for i, parts in held:
        weight = values.weight[values.root(i)]
        if i not in names and weight > 0 and weight + literal_weight("".join(v for _, _, v in parts)) >= threshold:
            found.update((a, b, "literal") for a, b, _ in parts if b > a)
    return sorted(found)


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in order)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) of each document.

    Spans are in code points, the end exclusive. The basic spans always stay; the lexer adds its
    own. A null text counts as empty: no spans, the SHA-256 of the empty string. Ids may be null
    or repeat; each row is scanned. Other columns are ignored; an empty table gives an empty
    result. Narrow: no shuffle; a worker holds one text and its constants at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = literal_spans(text or "", threshold)
                n = Counter(kind for _, _, kind in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
