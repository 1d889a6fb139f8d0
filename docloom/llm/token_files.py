"""Token-ID files: one zstandard frame a document, under a dictionary that all files share.

File format, little-endian throughout:
  header   magic "DLTOK1\\0\\0", id width in bytes (u32), number of documents (u32), SHA-256 of the
           dictionary (32 bytes; zeros: none)
  frames   one zstandard frame for each document, in the file's order
  index    for each document: id (i64), frame offset (u64), frame length (u32), id is null (u32),
           number of token ids (u64)
  footer   offset of the index (u64), magic again
The dictionary is a file of its own beside them, named in the manifest. Files are in ascending
order of the document ids, and so are the documents in each; the manifest, a Parquet table, has
one row a file. One document is read with two small reads: footer and index, then its frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, hash_fraction, in_hash_sample, open_input, open_output, task_file
from .tokens import Encoder, kept, load_tokenizer, read_definition

MAGIC = b"DLTOK1\0\0"
HEADER, FOOTER = "<8sII32s", "<Q8s"
HEADER_BYTES, FOOTER_BYTES = struct.calcsize(HEADER), struct.calcsize(FOOTER)
INDEX = np.dtype([("id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("null", "<u4"), ("n", "<u8")])
#: The dictionary is fitted on about this many documents, at most this many id bytes of each; it only
#: changes how small frames are, never what they hold.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 4096, 16_384, 65_536
MANIFEST = "part int, path string, n_docs long, n_tokens long, bytes long"


@dataclass
class TokenFiles:
    """Written files: a folder, its dictionary and its manifest (part, path, n_docs, n_tokens, bytes)."""

    folder: str
    dictionary: bytes
    manifest: DataFrame


def train_dictionary(docs: DataFrame, definition: str, width: int, id_col: str, text_col: str) -> bytes:
    """A shared dictionary from the serialised ids of a bounded sample; empty if there is too little to train on.

    The sample is the SAMPLE_DOCS different (id, text) with the lowest hashes, of which an equal row is one, so it is the
    same on every run and no id can fill it.
    """
    import zstandard

    key = ("encode", width, hashlib.sha256(definition.encode()).hexdigest())
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        encoder = kept(key, lambda: Encoder(sent.value, width))
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([encoder.text(t)[:SAMPLE_BYTES] for t in texts], pa.binary())], ["ids"])

    # Twice the share that is wanted is hashed below the mark, so that the lowest are among them.
    share = hash_fraction(docs.count(), 2 * SAMPLE_DOCS)
    marked = docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("mark")).filter(in_hash_sample(F.col("mark"), share))
    sample = marked.dropDuplicates(["mark"]).orderBy(F.xxhash64("mark"), "mark").limit(SAMPLE_DOCS).select("text").mapInArrow(run, "ids binary")
    found = sorted(bytes(r.ids) for r in sample.collect() if r.ids)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_token_files(docs: DataFrame, definition: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> TokenFiles:
    """Encode every whole text and write its ids to files in `folder`, in ascending order of the ids.

    Documents are range-partitioned by id, hash of the text and row, so even one id, or one row repeated,
    that holds a third of all rows is spread over tasks; each task encodes its range and writes one file. `end_id` is
    appended to each document (None: nothing is). A null text is empty: it holds the end id alone.
    A null id comes before all others. Repeated ids are kept, each row as a document. Other columns
    are ignored. An empty table gives no files. A task holds one document at a time, its
    compressed frames going straight to the file; a lost executor's half-written files are in no
    manifest.
    """
    import zstandard

    spark = docs.sparkSession
    vocabulary = load_tokenizer(definition).get_vocab_size(with_added_tokens=True)
    width = 2 if vocabulary <= 1 << 16 else 4
    trained = train_dictionary(docs, definition, width, id_col, text_col)
    digest = hashlib.sha256(trained).digest() if trained else bytes(32)
    if trained:
        with open_output(f"{folder}/dictionary.zst") as f:
            f.write(trained)
    key = ("encode", width, hashlib.sha256(definition.encode()).hexdigest())
    sent = spark.sparkContext.broadcast((definition, trained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(key, lambda: Encoder(sent.value[0], width))
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(sent.value[1]) if sent.value[1] else None)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        out, index, at = None, [], HEADER_BYTES
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    part, path = task_file(folder, ".dltok")
                    out = open_output(path)
                    out.write(struct.pack(HEADER, MAGIC, width, 0, digest))
                ids = encoder.text(text or "") + end
                frame = press.compress(ids)
                out.write(frame)
                index.append((number or 0, at, len(frame), number is None, len(ids) // width))
                at += len(frame)
        if out is None:
            return
        table = np.array(index, INDEX)
        out.write(table.tobytes())
        out.write(struct.pack(FOOTER, at, MAGIC))
        out.close()
        row = [part, path, len(index), int(table["n"].sum()), at]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "path", "n_docs", "n_tokens", "bytes"])

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange("id", "tie", "row")
        .sortWithinPartitions("id", "tie", "row")
        .select("id", "text")
    )
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return TokenFiles(folder, trained, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))


def open_frames(path: str):
    """(file, header's width, dictionary hash, index) of one file."""
    f = open_input(path)
    f.seek(f.size() - FOOTER_BYTES)
    at, magic = struct.unpack(FOOTER, f.read(FOOTER_BYTES))
    if magic != MAGIC:
        raise ValueError(f"not a token file: {path}")
    f.seek(at)
    index = np.frombuffer(f.read(f.size() - FOOTER_BYTES - at), INDEX)
    f.seek(0)
    _, width, _, digest = struct.unpack(HEADER, f.read(HEADER_BYTES))
    return f, width, digest, index


def _opener(trained: bytes, digest: bytes):
    import zstandard

    if digest != (hashlib.sha256(trained).digest() if trained else bytes(32)):
        raise ValueError("the file was written with another dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def read_document(path: str, doc_id: int, trained: bytes) -> list[np.ndarray]:
    """The ids of the documents with that id in one file, by index and frame alone."""
    f, width, digest, index = open_frames(path)
    with f:
        unpress, found = _opener(trained, digest), []
        for row in index[(index["id"] == doc_id) & (index["null"] == 0)]:
            f.seek(int(row["offset"]))
            found.append(np.frombuffer(unpress.decompress(f.read(int(row["length"]))), f"<u{width}").astype("<u4"))
        return found


def read_token_files(files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files.

    `start` is the number of ids in all documents before it; the manifest's running total, one row
    a file, gives each file's base. ids_crc32 is the CRC-32 of the ids as little-endian u32.
    """
    spark = files.manifest.sparkSession
    base, rows = 0, []
    # One row for each file, of the size of one task's output: metadata, not data.
    for r in sorted(files.manifest.collect(), key=lambda r: r.part):
        rows.append((r.path, base))
        base += r.n_tokens
    sent = spark.sparkContext.broadcast(files.dictionary)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, width, digest, index = open_frames(path)
                with f:
                    unpress = _opener(sent.value, digest)
                    f.seek(HEADER_BYTES)
                    starts = start + np.concatenate([[0], np.cumsum(index["n"].astype("i8"))[:-1]])
                    for at in range(0, len(index), 1024):
                        part, crcs, held = index[at : at + 1024], [], []
                        for row in part:
                            ids = np.frombuffer(unpress.decompress(f.read(int(row["length"]))), f"<u{width}").astype("<u4")
                            crcs.append(zlib.crc32(ids))
                            if with_ids:
                                held.append(ids.astype("i8"))
                        columns = [pa.array(part["id"], mask=part["null"] == 1), pa.array(starts[at : at + 1024]), pa.array(part["n"].astype("i8")), pa.array(crcs, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.list_(pa.int64()))] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "path string, base long").repartition(len(rows), "path")
    return listed.mapInArrow(run, schema)


def encode_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the documents' ids under the 50k byte-level vocabulary to fresh files and read them back: (doc_id,
    start, n_tokens, ids_crc32). Null and empty texts hold the end id alone, null ids come first, repeated rows are
    documents each, an empty table gives no row; other columns are ignored."""
    import public_tokenizers

    definition = read_definition(public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(write_token_files(docs, definition, fresh_path(spark, "tokens")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, lengths and checksums of all documents in the token files."""
    return encode_and_read(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
