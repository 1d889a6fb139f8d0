"""WARC archives with revisits: equal payloads are stored once.

Headers are shuffled by payload digest, payloads are not; the smallest page id of a digest is the response, the
others become revisit records that refer to it. Archives are gzip files of one member a record; every
header is written anew, nothing is copied from an earlier archive. A manifest names the files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, open_input, open_output, scratch, task_file

#: Name space of record ids; the capture date that records carry where the table has none.
RECORDS, DATE = uuid.UUID("6f1d3a52-5b0e-5c6e-9a0a-0f5d7f0f8c11"), "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, path string, n_records long, bytes long"
#: Bytes read from an archive at once, and of originals that are broadcast at most.
READ, BROADCAST = 1 << 20, 32 << 20


def digest_of(payload: bytes) -> str:
    """Base32 of the payload's SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, uri: str | None, digest: str) -> str:
    """The same for the same page on every run."""
    return f"<urn:uuid:{uuid.uuid5(RECORDS, f'{page_id} {uri} {digest}')}>"


def one_line(value: str | None) -> str:
    """A header value: line breaks and other controls percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, uri: str | None, payload: bytes, size: int, digest: str, original: tuple | None) -> bytes:
    """One WARC/1.1 record; with an original (page id, uri) it is a revisit and holds HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if original else http + payload
    head = {
        "WARC-Type": "revisit" if original else "response",
        "WARC-Record-ID": record_id(page_id, uri, digest),
        "WARC-Target-URI": one_line(uri),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{digest_of(block)}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
    }
    if original:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(original[0], original[1], digest), "WARC-Refers-To-Target-URI": one_line(original[1]), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-Id": str(original[0])}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def members(path: str) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    with open_input(path) as f:
        unpress, held, rest = zlib.decompressobj(31), [], b""
        while chunk := rest or f.read(READ):
            held.append(unpress.decompress(chunk))
            rest = b""
            if unpress.eof:
                yield b"".join(held)
                rest, held, unpress = unpress.unused_data, [], zlib.decompressobj(31)
        if any(held):
            raise ValueError(f"{path} ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record."""

    def fields(lines: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in lines.decode().split("\r\n")[1:])
        return {k.strip(): v.strip() for k, _, v in pairs}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def digests(pages: DataFrame, id_col: str, uri_col: str, html_col: str) -> DataFrame:
    """(page_id, uri, html, digest, size): payloads are the html in UTF-8, null: empty. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [p or b"" for p in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([digest_of(p) for p in payloads]), pa.array([len(p) for p in payloads], pa.int64())], ["page_id", "uri", "html", "digest", "size"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).alias("uri"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, "page_id long, uri string, html string, digest string, size long")


def deal(pages: DataFrame, id_col: str, uri_col: str, html_col: str, least_bytes: int, broadcast_bytes: int) -> DataFrame:
    """(page_id, uri, html, size, digest, of_id, of_uri) of each record; of_id is null for responses, and html for revisits.

    Headers (id, url, digest, size) are shuffled by digest and reduced to one original for each that several
    have, with map-side minima, so a payload that a third of all pages share is one row. Revisits are made of
    headers alone. Pages whose payload is theirs alone pass by: the table of originals is broadcast if it takes
    `broadcast_bytes` at most; beyond that pages are joined by digest and id, so that a payload of
    many pages is spread. Only where rows repeat an original whole are originals shuffled, to keep one of each.
    """
    hashed = digests(pages, id_col, uri_col, html_col)
    headers = materialize(hashed.select("page_id", "uri", "digest", "size").filter(F.col("size") >= least_bytes).withColumn("row", F.monotonically_increasing_id()), "headers")
    equal = headers.groupBy("digest", "page_id", "uri").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("row"))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri", "row", "m"))
    shared = materialize(equal.groupBy("digest").agg(F.sum("m").alias("n"), F.min(known).alias("original")).filter("n > 1 and original is not null").select("digest", "original"), "originals")
    taken, repeated = shared.agg(F.sum(F.coalesce(F.octet_length("original.uri"), F.lit(0)) + 100), F.max("original.m")).first()
    if (taken or 0) <= broadcast_bytes:
        met = hashed.join(F.broadcast(shared), "digest", "left")
        copies = headers.join(F.broadcast(shared), "digest")
    else:
        copies = headers.join(shared, "digest")
        marks = copies.select(F.col("digest").alias("d"), F.col("page_id").alias("p"), "original").distinct()
        met = hashed.join(marks, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left").drop("d", "p")
    alone = F.col("original").isNull() | (F.col("size") < least_bytes)
    first = ~alone & F.col("page_id").eqNullSafe(F.col("original.page_id")) & F.col("uri").eqNullSafe(F.col("original.uri"))
    whole = met.filter(alone | first)
    if (repeated or 0) > 1:
        once = met.filter(first & (F.col("original.m") > 1)).dropDuplicates(["digest"])
        whole = met.filter(alone | (first & (F.col("original.m") == 1))).union(once)
    none = F.lit(None)
    whole = whole.select("page_id", "uri", "html", "size", "digest", none.cast("long").alias("of_id"), none.cast("string").alias("of_uri"))
    again = copies.filter("row != original.row")
    return whole.union(again.select("page_id", "uri", none.cast("string").alias("html"), "size", "digest", F.col("original.page_id").alias("of_id"), F.col("original.uri").alias("of_uri")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least_bytes: int = 0, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """Write all pages to WARC files in `folder` and return the manifest (part, path, n_records, bytes).

    Of pages with equal payloads of at least `least_bytes` bytes, the one with the smallest id (then url) is
    the response and the others revisit it, rows that repeat it too; pages with smaller payloads are all
    responses. Rows with a null id never are originals of others, and are responses where no row with
    an id has their payload. A null html is an empty payload, a null url an empty one. Other columns are
    ignored. An empty table writes no file. Pages are read twice, for their headers and for the records.
    """
    with scratch(pages.sparkSession):
        dealt = deal(pages, id_col, uri_col, html_col, least_bytes, broadcast_bytes)
        _write(dealt, folder)
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _write(dealt: DataFrame, folder: str) -> None:
    """Each task writes its records to one file and gives a row of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size = None, 0, 0
        for batch in batches:
            for page, uri, html, length, digest, of_id, of_uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    part, path = task_file(folder, ".warc.gz")
                    out = open_output(path)
                original = None if of_id is None else (of_id, of_uri)
                data = gzip_member(record(page, uri, (html or "").encode(), length, digest, original))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n]), pa.array([size])], ["part", "path", "n_records", "bytes"])

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to) of each record, from the files.

    A response's digest is taken anew from its payload and must agree with its header; a revisit's
    size and digest stand in its headers. One record is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        rows: list[tuple] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for data in members(path):
                    warc, http, payload = parse(data)
                    digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                    if kind == "response" and (digest_of(payload), len(payload)) != (digest, int(http["Content-Length"])):
                        raise ValueError(f"a record in {path} has a wrong digest or length")
                    page, of = warc["X-Page-Id"], warc.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, warc["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, int(of) if of else None))
                    if len(rows) >= 8192:
                        yield full()
                        rows = []
        if rows:
            yield full()

    files = manifest.count()
    listed = manifest.select("path").repartition(max(files, 1), "path")
    return listed.mapInArrow(run, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT *, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS k FROM p),
n AS (SELECT *, list_transform(range(41), lambda i: greatest(strpos('0123456789abcdef', substr(x || '0', i + 1, 1)) - 1, 0)) AS d FROM h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((d[i * 5 // 4 + 1] * 16 + d[i * 5 // 4 + 2]) >> (3 - i * 5 % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first END AS refers_to
FROM n
"""
