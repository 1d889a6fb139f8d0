"""Many keywords at once: a failure-link automaton of a rule table, walked once over each text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of keywords in a shard; its automaton takes about 100 bytes for each in a worker.
SHARD_CHARACTERS = 500_000
#: Keywords in a shard, and shards whose automata a worker holds at once.
BLOCK, TOGETHER = 50_000, 3

#: A worker's automata, the latest used last.
_HELD: dict[str, object] = {}


def shards(rules: DataFrame, block: int = BLOCK, characters: int = SHARD_CHARACTERS) -> Iterator[list[tuple[str, str]]]:
    """Different (category, keyword) without nulls in lists of bounded size; the driver holds one partition and one list at a time."""
    held, size = [], 0
    for category, keyword in rules.select("category", "keyword").dropna().distinct().toLocalIterator():
        if held and (len(held) == block or size + len(keyword) > characters):
            yield held
            held, size = [], 0
        held.append((category, keyword))
        size += len(keyword)
    if held:
        yield held


class Automaton:
    """Categories of the keywords that a text holds."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        import ahocorasick

        named: dict[str, set[str]] = {}
        for category, keyword in rules:
            named.setdefault(keyword, set()).add(category)
        self.always = frozenset(named.pop("", ()))
        self.most = len({c for c, _ in rules})
        self.tree = ahocorasick.Automaton()
        for keyword, categories in named.items():
            self.tree.add_word(keyword, tuple(categories))
        self.tree.make_automaton()

    def categories(self, text: str) -> set[str]:
        """Walks on until the text ends or every category is found."""
        found = set(self.always)
        if len(self.tree):
            for _, categories in self.tree.iter(text):
                found.update(categories)
                if len(found) == self.most:
                    break
        return found


def _kept(key: str, make: Callable[[], Automaton]) -> Automaton:
    made = _HELD.pop(key, None)
    if made is None:
        while len(_HELD) >= TOGETHER:
            del _HELD[next(iter(_HELD))]
        made = make()
    _HELD[key] = made
    return made


def found_by(sent: list, text: Column) -> Column:
    """Array of the categories that the broadcast shards give a text, sorted; null texts have none."""
    shared = [(uuid.uuid4().hex, s) for s in sent]

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        automata = [_kept(key, lambda s=s: Automaton(s.value)) for key, s in shared]
        return pd.Series([None if t is None else sorted(set().union(*(a.categories(t) for a in automata))) for t in texts])

    return found(text)
