"""Token counts and token files against the library itself."""

import random
import zlib

import numpy as np
import pytest

from docloom.llm import token_files, tokens
from docloom.llm.common import fresh_path

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def definition():
    return tokens.read_definition(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library(definition):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def test_whole_tokens_are_proven(library):
    proven = tokens.proven_whole(library)
    assert "Ġthe" in proven and len(proven) > 40_000


def test_pieces_agree_with_whole_texts(definition, library):
    counter, encoder = tokens.Counter(definition, tokens.proven_whole(library)), tokens.Encoder(definition, 2)
    alphabet = [*"_ \n\t ab'st.,1²½éêÀǅΩ世\x1c\x85\x1f٣ªº-😀", "  ", "'ll", " the", "\r\n", "<|endoftext|>"]
    rng = random.Random(1)
    for _ in range(5_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert counter.text(text) == len(ids), text
        assert np.frombuffer(encoder.text(text), "<u2").tolist() == ids, text


def test_small_table_of_pieces_changes_nothing(definition, library):
    encoder = tokens.Encoder(definition, 2)
    encoder.spaced.most = 3
    text = "one two three four five, two three. one six seven one"
    assert np.frombuffer(encoder.text(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts(awkward, nothing, definition, library):
    rows = tokens.count_tokens(awkward, definition, limit=5).collect()
    given = [(r.doc_id, r.text or "") for r in awkward.select("doc_id", "text").collect()]
    wanted = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 5) for i, t in given]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))
    assert tokens.count_tokens(nothing, definition).count() == 0


def test_files_round_trip(spark, awkward, nothing, definition, library):
    files = token_files.write_token_files(awkward, definition, fresh_path(spark, "test"))
    rows = sorted(token_files.read_token_files(files, with_ids=True).collect(), key=lambda r: r.start)
    given = {}
    for r in awkward.select("doc_id", "text").collect():
        given.setdefault(r.doc_id, []).append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    at = 0
    for r in rows:
        given[r.doc_id].remove(r.ids)
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert not any(given.values())
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.read_token_files(token_files.write_token_files(nothing, definition, fresh_path(spark, "test"))).count() == 0


def test_single_document_by_index(spark, definition, library):
    d = spark.createDataFrame([(i, f"document {i} " * (i + 1)) for i in range(300)], "doc_id long, text string")
    files = token_files.write_token_files(d, definition, fresh_path(spark, "test"))
    assert files.dictionary, "300 documents are enough for a dictionary"
    found = [ids.tolist() for r in files.manifest.collect() for ids in token_files.read_document(r.path, 123, files.dictionary)]
    assert found == [[*library.encode("document 123 " * 124, add_special_tokens=False).ids, 0]]
    with pytest.raises(ValueError):
        token_files.read_document(files.manifest.first().path, 123, b"another")


def test_table_of_pieces_is_bound_in_bytes(definition, library, monkeypatch):
    import random as r

    monkeypatch.setattr(tokens, "TABLE_BYTES", 200_000)
    counter = tokens.Counter(definition, tokens.proven(definition))
    rng = r.Random(3)
    han = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(50_000))
    parts = [han[i : i + rng.randint(1, 400)] for i in range(0, 40_000, 40)] + ["QUJD" * rng.randint(1, 300) + str(i) for i in range(300)]
    for text in (" ".join(parts[:400]), " ".join(parts[400:])):
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids)
    for table in (counter.spaced, counter.bare):
        assert table.taken <= table.most and max(map(len, [*table, *table.old, ""])) <= tokens.LONGEST


def test_repeated_rows_and_hot_ids(spark, definition, library):
    rows = [(5, "the very same row")] * 3000 + [(5, f"row {i}") for i in range(50)] + [(i, "x") for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), definition, fresh_path(spark, "test"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_token_files(files).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert max(r.n_docs for r in files.manifest.collect()) < 2500, "equal rows are spread"
    again = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), definition, fresh_path(spark, "test"))
    assert again.dictionary == files.dictionary
