"""Quotes, links, threads."""

from docloom.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string"


def test_parse():
    body, quotes = C.parse_quotes("On Monday, Bob wrote:\n> It writes\n> FILES.\n>\n> Two.\n>> Older  one\nMine.\n> x\nend 3 > 2")
    assert body == "Mine.\nend 3 > 2"
    assert quotes == [(1, "it writes files."), (1, "two."), (1, "it writes files. two."), (2, "older one"), (1, "x")]
    assert C.parse_quotes("") == ("", []) and C.parse_quotes("a\n\n\n\nb") == ("a\n\n\n\nb", [])
    assert C.parse_quotes("> > a\n>>b\n> c")[1] == [(2, "a b"), (1, "c")]


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nHow does a  Spark\nshuffle work?"),
        (1, 1, "assistant", "> How does a Spark shuffle\n> work?\n\nIt writes sorted files."),
        (1, 2, "user", "An unrelated start"),
        (1, 3, "assistant", "On Monday, Bob wrote:\n> It writes SORTED files.\n>> How does a Spark shuffle work?\nMore: they are fetched."),
        (1, 4, "user", "> nobody said this\nwell"),
        (1, 5, "user", ">> How does a spark shuffle work?\n> It writes sorted files.\nok"),
        (2, 0, "user", "> An unrelated start\nfrom elsewhere"),
        (2, 1, None, None),
        (None, 3, "user", "x"),
        (2, None, "user", "> x\ny"),
    ]
    got = C.format_chats(spark.createDataFrame(rows, ROWS)).orderBy("seq").collect()
    assert [(r.conv_id, r.turn, r.reply_to, r.thread, r.depth) for r in got] == [
        (None, 3, None, 3, 0), (1, 0, None, 0, 0), (1, 1, 0, 0, 1), (1, 3, 1, 0, 2), (1, 5, 1, 0, 2), (1, 2, None, 2, 0), (1, 4, None, 4, 0),
        (2, None, None, None, 0), (2, 0, None, 0, 0), (2, 1, None, 1, 0),
    ]
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[2, 0].other_conv == 1 and by[1, 4].n_linked == 0 and by[1, 3].n_linked == 2
    assert by[2, 1].chat == "<|im_start|>user\n<|im_end|>\n" and by[1, 1].body == "It writes sorted files."


def test_long_chain_and_common_first_turn(spark):
    rows = [(1, i, "user", f"> message {i - 1} says so\n\nmessage {i} says so" if i else "message 0 says so") for i in range(40)]
    rows += [(100 + i, 0, "user", "good morning all") for i in range(500)] + [(100 + i, 1, "user", "> good morning all\nhi") for i in range(500)]
    got = C.format_chats(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 1040
    assert {(r.depth, r.thread) for r in got if r.conv_id == 1} == {(i, 0) for i in range(40)}
    assert all(r.reply_to == 0 and r.other_conv is None for r in got if r.conv_id > 1 and r.turn == 1)


def test_empty_and_repeated(spark):
    assert C.format_chats(spark.createDataFrame([], ROWS)).count() == 0
    d = spark.createDataFrame([(1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 1, "bot", "> a b\nc")], ROWS).selectExpr("*", "'q' AS body", "'q' AS thread", "'q' AS hash")
    assert sorted((r.turn, r.reply_to) for r in C.format_chats(d).collect() if r.turn) == [(1, 0)] and C.format_chats(d).count() == 3
