"""Links and bodies against plain rules on a generated corpus with nested, trimmed and unknown quotes."""

import random
import re

from docloom.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string"
WORDS = "red green blue gold iron wood salt rain snow wind leaf root".split()


def corpus():
    """Rows, and for each its own text and the texts that it quotes as (level, text)."""
    rng = random.Random(11)
    rows, truth = [], {}
    for conv in range(25):
        said = []
        for turn in range(rng.randint(1, 9)):
            own = [" ".join(rng.choice(WORDS) for _ in range(5)) + f" {conv} {turn} {i}." for i in range(rng.randint(1, 3))]
            quotes, lines = [], []
            if said and rng.random() < 0.7:
                of = rng.randrange(len(said))
                level = 1
                while True:
                    part = rng.choice(said[of][0])
                    quotes.append((level, part, of))
                    lines.append("> " * level + part.upper() if rng.random() < 0.3 else ">" * level + " " + part)
                    if not said[of][1] or rng.random() < 0.4:
                        break
                    of, level = rng.choice(said[of][1]), level + 1
            if rng.random() < 0.3:
                lines += ["", f">>> import thing{conv}", f"> nobody said {conv} {turn}", ""]
            text = "\n".join([*(["Bob wrote:"] if quotes and lines[0].startswith(">") and rng.random() < 0.5 else []), *lines, *own])
            rows.append((conv, turn, rng.choice(["user", "bot"]), text))
            said.append((own, [of for _, _, of in quotes]))
            truth[conv, turn] = (own, quotes)
    return rows, truth


def plain(rows):
    """reply_to of each message: of its quoted lines in order of level and place, the first message before it that says one."""
    own = {}
    for conv, turn, _, text in rows:
        own[conv, turn] = {C.normal(x) for x in text.split("\n") if not x.lstrip().startswith(">")}
    found = {}
    for conv, turn, _, text in rows:
        best = None
        for place, line in enumerate(text.split("\n")):
            if m := re.match(r"((?:> ?)+)(.*)", line):
                origin = [t for t in range(turn) if (conv, t) in own and C.normal(m[2]) in own[conv, t]]
                if origin and C.normal(m[2]):
                    best = min(best or (9, 0, 0), (m[1].count(">"), place, origin[0]))
        found[conv, turn] = best[2] if best else None
    return found


def test_links_equal_the_plain_rule(spark):
    rows, truth = corpus()
    got = {(r.conv_id, r.turn): r for r in C.format_chats(spark.createDataFrame(rows, ROWS)).collect()}
    assert {k: r.reply_to for k, r in got.items()} == plain(rows)
    assert sum(r.reply_to is not None for r in got.values()) > 40
    for key, (own, quotes) in truth.items():
        lines = got[key].body.split("\n")
        assert [x for x in lines if x in own] == own, "own lines stay, in order"
        assert not any(C.normal(part) in {C.normal(x.lstrip("> ")) for x in lines if x.startswith(">")} for _, part, _ in quotes), "linked quotes go"
        assert (f">>> import thing{key[0]}" in lines) == (f">>> import thing{key[0]}" in dict(((c, t), x) for c, t, _, x in rows)[key].split("\n"))
    depth = {}
    for (conv, turn), r in sorted(got.items()):
        depth[conv, turn] = 0 if r.reply_to is None else depth[conv, r.reply_to] + 1
        assert r.depth == depth[conv, turn]


def test_what_quotes_nobody_stays(spark):
    text = "Run:\n>>> import os\nwhat?"
    rows = [(1, 0, "user", text), (1, 1, "bot", "x" * 90 + " wrote:\n> Run:\nok"), (1, 2, "bot", "Bob wrote:\n> never said\nok\n\n\n\nend"), (2, 0, "user", "a\n>\nb")]
    got = {(r.conv_id, r.turn): r.body for r in C.format_chats(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {(1, 0): text, (1, 1): "ok", (1, 2): rows[2][3], (2, 0): "a\n>\nb"}


def test_second_conversation_that_says_it_is_the_origin(spark):
    rows = [(1, 0, "user", "> said elsewhere\nmine"), (1, 1, "user", "said elsewhere"), (5, 0, "user", "said elsewhere"), (7, 0, "user", "said elsewhere")]
    got = {(r.conv_id, r.turn): r for r in C.format_chats(spark.createDataFrame(rows, ROWS)).collect()}
    assert (got[1, 0].reply_to, got[1, 0].other_conv, got[1, 0].body) == (None, 5, "mine")


def test_long_texts_ties_and_repeated_turns(spark):
    long = "\n".join(f"> line {i} of many" if i % 2 else f"own line {i}" for i in range(20_000))
    rows = [(1, 0, "user", "line 1 of many"), (1, 1, "bot", long), (1, 1, "bot", "> line 1 of many\nshort"), (1, 1, "bot", "> line 1 of many\nshort")] + [(3, 0, "user", "same words")] * 400
    got = C.format_chats(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows) and len({r.seq for r in got}) == len(rows)
    assert sorted(r.body for r in got if r.turn == 1)[-2:] == ["short", "short"]
    big = max(got, key=lambda r: len(r.body))
    assert "> line 3 of many" in big.body and "> line 1 of many" not in big.body and big.reply_to == 0 and big.n_linked >= 1


def test_introducing_lines_take_linear_time():
    import time

    began = time.time()
    for t in (" " * 300_000 + "\n> x", "wrote " * 60_000 + "\n> x", "on " + "wrote   " * 50_000 + "\n> x"):
        C.parse_quotes(t)
    assert time.time() - began < 5
