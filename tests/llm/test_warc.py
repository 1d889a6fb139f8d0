"""Archives written and read back."""

import gzip
import random

import duckdb
import pytest

from docloom.llm import warc as W
from docloom.llm.common import fresh_path, open_input

PAGES = "page_id long, url string, html string"


def run(spark, rows, **options):
    manifest = W.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), fresh_path(spark, "test"), **options)
    return manifest, sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.read_archives(manifest).collect()), key=str)


def test_revisits(spark):
    rows = [(None, "u", "x"), (1, None, "x"), (2, "a\r\nb", "x"), (None, "n", "y"), (None, "m", "y"), (5, "e", None), (6, "f", ""), (1, None, "x"), (9, "é", "ünï")]
    _, got = run(spark, rows)
    assert got == sorted([(None, 1, "revisit", 1), (1, 1, "response", None), (2, 1, "revisit", 1), (None, 1, "response", None), (None, 1, "response", None), (5, 0, "response", None), (6, 0, "revisit", 5), (1, 1, "revisit", 1), (9, 5, "response", None)], key=str)


def plain(rows):
    """Record types by hand: one response for each payload, at the smallest id."""
    first, out = {}, []
    for i, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        payload = (h or "").encode()
        if payload in first and first[payload] is not None:
            out.append((i, len(payload), "revisit", first[payload]))
        else:
            first.setdefault(payload, i)
            out.append((i, len(payload), "response", None))
    return sorted(out, key=str)


@pytest.mark.parametrize("room", [W.BROADCAST, 0])
def test_both_ways_equal_the_plain_rule(spark, room):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["u", "v", None]), rng.choice(["a", "b", "c", "", None, "x" * rng.randrange(30)])) for _ in range(300)]
    rows += [(1000 + i, "u", "a third of all") for i in range(200)] + [(2000, "u", "equal rows")] * 100
    manifest, got = run(spark, rows, broadcast_bytes=room)
    assert got == plain(rows)
    with_html = sum(k == "response" for _, _, k, _ in got)
    assert sum(r.n_records for r in manifest.collect()) == len(rows) > with_html


def test_small_payloads_are_responses(spark):
    _, got = run(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "xyz"), (4, "d", "xyz")], least_bytes=3)
    assert got == sorted([(1, 2, "response", None), (2, 2, "response", None), (3, 3, "response", None), (4, 3, "revisit", 3)], key=str)


def test_large_group_and_long_payload(spark):
    rows = [(i, "u", "same") for i in range(2000)] + [(5000, "v", "long " * 1_000_000)]
    manifest, got = run(spark, rows)
    assert sum(k == "revisit" and of == 0 for _, _, k, of in got) == 1999
    assert sum(r.n_records for r in manifest.collect()) == 2001


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [])[1] == []
    d = spark.createDataFrame([(1, "u", "x")], PAGES).selectExpr("*", "'q' AS digest", "'q' AS size", "'q' AS original")
    assert W.read_archives(W.write_archives(d, fresh_path(spark, "test"))).first().payload_digest == W.digest_of(b"x")


def test_records_are_plain_warc(spark):
    manifest, _ = run(spark, [(7, "http://x/", "payload"), (8, "http://y/", "payload")])
    texts = []
    for r in manifest.collect():
        with open_input(r.path) as f:
            texts.append(gzip.decompress(f.read()).decode())
    text = "".join(texts)
    assert text.count("WARC/1.1\r\n") == 2 and text.count("payload\r\n\r\n") == 1 and "WARC-Refers-To-Target-URI: http://x/" in text
    assert W.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_sql_on_pages_with_copies(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i % 7}" if i % 3 else "one for a third") for i in range(120)] + [(5, "u5", "page 5")] * 3 + [(None, "n", "alone"), (None, "m", "alone"), (None, "p", "page 4"), (200, "q", None), (201, "r", "")]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, W.op8_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(W.OP8_SQL).fetchall(), key=str) and sum(r[3] == "revisit" for r in got) > 100


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    got = sorted(map(tuple, W.op8_warc(spark, "/root/testdata/sf0.01").collect()))
    assert got == sorted(con.execute(W.OP8_SQL).fetchall())
