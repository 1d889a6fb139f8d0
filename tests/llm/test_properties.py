"""Properties that hold for any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import chat, decontaminate, secrets, simhash, tokens, toxicity

P = pytest.importorskip("public_tokenizers")
DEFINITION = tokens.read_definition(P.path("byte_bpe_50k.json"))
LIBRARY = tokens.load_tokenizer(DEFINITION)
COUNTER = tokens.Counter(DEFINITION, tokens.proven_whole(LIBRARY))
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=800, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(text):
    assert COUNTER.text(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", ": ", '"', "AKIA", "ABCDEF0123456789", "abcdef0123456789", " ", "\n", "é", "password", "x"]), max_size=25).map("".join))
def test_basic_spans_equal_the_patterns(text):
    wanted = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
    wanted += [(m.start(), m.end(), "access") for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 18]
    wanted += [(m.start(), m.end(), "hex") for m in secrets.HEX.finditer(text) if len(m[0]) >= 16]
    assert secrets.base_spans(text) == wanted
    assert all(0 <= a < b <= len(text) for a, b, _ in secrets.literal_spans(text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_own_text_holds_no_quote(text):
    body, quotes = chat.parse_quotes(text)
    assert (body == text) or quotes
    assert not quotes or not chat.parse_quotes(body)[1]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_folding_twice_changes_nothing(text):
    once = toxicity.fold(text)
    assert toxicity.fold(once).isspace() == once.isspace() and "  " not in once.strip()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_an_item_is_found_in_any_text_around_it(before, after):
    item = "one two three four five six seven eight nine ten"
    found = decontaminate.Matcher([(1, item)], 0.2).find(" ".join([*before, item, *after]))
    assert [(f[0], f[1]) for f in found] == [(1, 0)]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_fingerprints_only_see_words(text):
    b = text.encode()
    assert simhash.fingerprint(b) == simhash.fingerprint(b" " + b" \n ".join(b.lower().split()) + b"\t")
