"""Texts made to be slow or large: twice the text takes about twice the time, and bounded memory."""

import time
import tracemalloc

import pytest

from docloom.llm import chat, secrets, toxicity
from docloom.llm.decontaminate import Matcher

SHARED = "which of the following is the best answer to the question below"
MATCHER = Matcher([(i, f"{SHARED} item{i} has words{i} of{i} its{i} own{i} and more{i}") for i in range(500)], 0.2)
GOOD = f"{SHARED} item7 has words7 of7 its7 own7 and more7 "


def lexed(text):
    secrets.base_spans(text)
    secrets.literal_spans(text)


CASES = {
    "yaml keys": (lexed, "- k:\n"),
    "yaml keys in": (lexed, "a:\n  - k:\n"),
    "yaml lists": (lexed, "k:\n- password: |\n"),
    "yaml items": (lexed, "- - a\n"),
    "yaml blocks": (lexed, "k: |\n k: |\n"),
    "yaml pipes": (lexed, " |\n"),
    "calls": (lexed, "token(('"),
    "chains": (lexed, "a=b=c="),
    "strings": (lexed, 'a="b="+'),
    "triples": (lexed, "a='''b="),
    "brackets": (lexed, "a[b["),
    "types": (lexed, "a: b.c[d] "),
    "tags": (lexed, "<a><b>"),
    "aliases": (lexed, "secret = a\na = secret\n"),
    "hex": (lexed, "deadbeef"),
    "parted": (toxicity.fold, "a."),
    "parted accents": (toxicity.fold, "é·a-"),
    "signs": (toxicity.fold, "!"),
    "signs and letters": (toxicity.fold, "!!!!a"),
    "digits": (toxicity.fold, "1"),
    "zero width": (toxicity.fold, "a\u200b."),
    "said": (chat.introduces, "am schrieb "),
    "said and colons": (chat.introduces, "am schrieb: "),
    "wrote": (chat.introduces, "on wrote "),
    "spaces": (chat.introduces, "on wrote" + " " * 50),
    "quotes": (chat._parse, "> a\n"),
    "levels": (chat._parse, "> > > a\n\n"),
    "introduced": (chat._parse, "am x schrieb:\n> a\n"),
    "marks": (chat._parse, ">"),
    "sentences": (chat._parse, "> a. b! "),
    "shared opening": (MATCHER.find, SHARED + " "),
    "shared opening and the rest": (MATCHER.find, SHARED + " item7 own7 more7 has words7 of7 its7 and "),
}


def took(run, text):
    began = time.process_time()
    run(text)
    return time.process_time() - began


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("end", ["", "x ", "a:"])
def test_linear(name, end):
    run, unit = CASES[name]
    half, whole = (unit * (n // len(unit)) + end for n in (500_000, 1_000_000))
    for _ in range(3):
        a, b = took(run, half), took(run, whole)
        if b <= max(2.5 * a, 0.3):
            break
    assert b <= max(2.5 * a, 0.3) and b < 40


@pytest.mark.parametrize("name", CASES)
def test_memory(name):
    run, unit = CASES[name]
    text = unit * (200_000 // len(unit))
    tracemalloc.start()
    run(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 300 MB for 1 MB of text


def growing(depth):
    return "".join(" " * i + "- k:\n" for i in range(depth)) + (" " * depth + "- v\n") * depth


@pytest.mark.parametrize("build", [growing, lambda d: "".join(" " * i + "k: |\n" for i in range(d)) + (" " * d + "v\n") * d], ids=["lists", "blocks"])
def test_nested_yaml(build):
    half, whole = build(577), build(816)
    assert 450_000 < len(half) < 550_000 and 0.9e6 < len(whole) < 1.1e6
    a, b = took(lexed, half), took(lexed, whole)
    assert b <= max(2.5 * a, 0.5)


def test_still_found():
    yaml = "auth:\n  token:\n    - Zk3v9QpX1mB7tLw2\n  - other\nkey:\n- a: 1\n"
    assert [yaml[a:b] for a, b, _ in secrets.literal_spans(yaml)] == ["Zk3v9QpX1mB7tLw2"]
    yaml = "- secret_keys:\n    - Zk3v9QpX1mB7tLw2\n\n    - 'Yk3v9QpX1mB7tLw3'\n- name: x\n"
    assert [yaml[a:b] for a, b, _ in secrets.literal_spans(yaml)] == ["Zk3v9QpX1mB7tLw2", "Yk3v9QpX1mB7tLw3"]
    yaml = "private_key: >-\n    Zk3v9QpX1mB7\n    tLw2Zk3v9QpX1\nnext: 1\n"
    assert [yaml[a:b] for a, b, _ in secrets.literal_spans(yaml)] == ["Zk3v9QpX1mB7", "tLw2Zk3v9QpX1"]
    assert " idiot" in toxicity.fold("an i.d.iot here") and toxicity.fold("no!!").strip() == "no"
    assert chat.introduces("Am Mo., 3. Mai um 10:23 schrieb Max <a@b>:") and chat.introduces("On Monday Ann wrote :") and not chat.introduces("we wrote to them")
    hits = MATCHER.find((SHARED + " ") * 50 + GOOD + (SHARED + " ") * 50)
    assert [h[0] for h in hits] == [7] and hits[0][1] == 0
