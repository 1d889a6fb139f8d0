"""Quotes of a part of a paragraph find the message that says it."""

from docloom.llm import chat as C


def test_trimmed_and_rewrapped_quotes(spark):
    rows = [
        (1, 0, "user", "first line\nsecond line\nthird line"),
        (1, 1, "bot", "> second line\nyes"),
        (1, 2, "user", "One thing is set. Another one\nis open still. The end"),
        (1, 3, "bot", "> Another\n> one is open still.\nno"),
        (1, 4, "user", "is open still.\nsecond line"),
        (1, 5, "bot", "> second line\n> third line\n> added by hand, long\nok"),
        (2, 0, "user", "second line and more"),
        (2, 1, "bot", "> second\nwell"),
    ]
    got = {(r.conv_id, r.turn): r for r in C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, i].reply_to for i in range(6)] == [None, 0, None, 2, None, 0]
    assert got[1, 1].n_quotes == got[1, 1].n_linked == 1 and got[2, 1].n_linked == 0
