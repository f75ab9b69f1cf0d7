"""Token ids in seekable binary files: one Zstandard dictionary for all files, each document compressed by itself.

A file: the header (magic, version, bytes of an id, SHA-256 of the dictionary), the frames of the documents in
ascending order of doc_id, the index (doc_id, offset, compressed bytes, ids; 28 bytes each, little-endian), and
the footer (number of documents, offset of the index, magic). A reader of one short document reads the footer, an
index entry and one frame. The dictionary lies beside the files under its SHA-256.

Defined results: a null or empty text has the end id alone (or no ids without one); null ids of documents come
first and are written as the smallest 64-bit integer; rows of one doc_id are written one after the other, each
with a place of its own; ids that are no integers are refused; an empty table gives no files and no rows; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import words as W
from .store import fresh, kept, long_id, parts
from .tokens import BLOCK_BYTES, encoder

MAGIC = b"TOKZST\x01\x00"
HEAD, TAIL, ENTRY = struct.Struct("<8sHH32s"), struct.Struct("<QQ8s"), np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u8")])
NO_ID = -(1 << 63)
#: The dictionary is trained on at most so many documents, of which at most so many bytes of ids each count.
DICT_DOCS, DICT_DOC_BYTES, DICT_BYTES, LEVEL = 2000, 16384, 65536, 3
#: A task starts another file beyond so many bytes.
FILE_BYTES = 64 << 20


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def _width(ids_below: int) -> np.dtype:
    return np.dtype("<u2") if ids_below <= 1 << 16 else np.dtype("<u4")


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from serialized id arrays. Where they are too few or too alike to train on, it is made of the arrays
    themselves (as raw content, the last DICT_BYTES of them), so that there always is one."""
    import zstandard

    raw = b"".join(samples)[-DICT_BYTES:].ljust(8, b"\0")
    size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, [s for s in samples if len(s) >= 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return raw


def _sample_task(path: str, end_id: int | None, width: np.dtype) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, most = encoder(path, end_id), DICT_DOC_BYTES // width.itemsize
        for batch in batches:
            out, chosen = [], batch.column(0).to_pylist()
            for block in W.blocks(batch.column(1), BLOCK_BYTES):
                ids, at = coder.encode(block)
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    skip = chosen[block.first + k] % max(1, b - a - most + 1)  # a run of ids from anywhere in the text
                    out.append(ids[a + skip : min(b, a + skip + most)].astype(width).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["h", "ids"])

    return task


def sample_ids(docs: DataFrame, path: str, end_id: int | None, width: np.dtype) -> list[bytes]:
    """Serialized ids (a run of at most DICT_DOC_BYTES of each) of the DICT_DOCS documents whose doc_ids have the smallest
    hashes: a bounded sample, encoded in tasks."""
    picked = [r[0] for r in docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_DOCS).collect()]
    rows = docs.where(F.col("doc_id").isin(picked)).select(F.xxhash64("doc_id").alias("h"), "text").orderBy("h", "text").limit(DICT_DOCS)
    return [bytes(r.ids) for r in rows.mapInArrow(_sample_task(path, end_id, width), "h long, ids binary").orderBy("h", "ids").collect()]


class _Writer:
    def __init__(self, folder: str, dictionary: bytes, width: np.dtype):
        import zstandard

        self.name = f"{folder}/{uuid.uuid4().hex}.tok"
        fs, path = _open(self.name)
        self.out = fs.open_output_stream(path, compression=None)
        self.out.write(HEAD.pack(MAGIC, 1, width.itemsize, hashlib.sha256(dictionary).digest()))
        self.at, self.entries, self.n_ids = HEAD.size, [], 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)

    def add(self, doc_id: int, ids: bytes, n: int) -> None:
        frame = self.zip.compress(ids)
        self.entries.append((doc_id, self.at, len(frame), n))
        self.out.write(frame)
        self.at += len(frame)
        self.n_ids += n

    def close(self) -> tuple[str, int, int]:
        self.out.write(np.array(self.entries, ENTRY).tobytes())
        self.out.write(TAIL.pack(len(self.entries), self.at, MAGIC))
        self.out.close()
        return self.name, len(self.entries), self.n_ids


def _write_task(folder: str, dictionary: bytes, path: str, end_id: int | None, width: np.dtype) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, done = encoder(path, end_id), None, []
        for batch in batches:
            doc_ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for block in W.blocks(batch.column(1), BLOCK_BYTES):
                ids, at = coder.encode(block)
                raw, step = memoryview(ids.astype(width)).cast("B"), width.itemsize
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if writer is None:
                        writer = _Writer(folder, dictionary, width)
                    writer.add(int(doc_ids[block.first + k]), raw[a * step : b * step], b - a)
                    if writer.at >= FILE_BYTES:
                        done.append(writer.close())
                        writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(
            [{"seq": k, "file": f, "n_docs": d, "n_ids": n} for k, (f, d, n) in enumerate(done)],
            schema=pa.schema([("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    return task


def write(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids of docs (doc_id, text) to files; returns the manifest: file, n_docs, n_ids, base (ids before it).

    Rows are dealt by ranges of doc_id and sorted there, so that files follow each other in that order. A task that
    runs twice writes other names; the manifest lists those of the run that counted.
    """
    spark = docs.sparkSession
    folder = folder or fresh(spark, "tokens")
    coder = encoder(tokenizer, end_id)
    width = _width(max(coder.tokenizer.get_vocab_size(), (end_id or 0) + 1))
    dictionary = train_dictionary(sample_ids(docs, tokenizer, end_id, width))
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.dict", compression=None) as f:
        f.write(dictionary)
    rows = docs.select(long_id(docs), "text").repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id")
    told = rows.mapInArrow(_write_task(folder, dictionary, tokenizer, end_id, width), "seq long, file string, n_docs long, n_ids long")
    told = kept(told.withColumn("part", F.spark_partition_id()), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return told.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))


def read_file(uri: str) -> Iterator[tuple[int, np.ndarray]]:
    """Every document of a file: its id and ids, in the file's order."""
    import zstandard

    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        n, index, magic = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
        first, _, step, sha = HEAD.unpack(f.read_at(HEAD.size, 0))
        if magic != MAGIC or first != MAGIC:
            raise ValueError(f"{uri} is no file of this kind")
        with fs.open_input_file(f"{path.rpartition('/')[0]}/{sha.hex()}.dict") as d:
            dictionary = d.read()
        if hashlib.sha256(dictionary).digest() != sha:
            raise ValueError(f"{uri} was written with another dictionary")
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        entries = np.frombuffer(f.read_at(n * ENTRY.itemsize, index), ENTRY)
        lo = 0
        while lo < n:  # a few MB at once
            hi = max(lo + 1, int(np.searchsorted(entries["offset"], entries["offset"][lo] + (4 << 20))))
            start = int(entries["offset"][lo])
            stop = int(entries["offset"][hi - 1]) + int(entries["size"][hi - 1])
            raw = memoryview(f.read_at(stop - start, start))
            for e in entries[lo:hi]:
                a = int(e["offset"]) - start
                yield int(e["doc_id"]), np.frombuffer(unzip.decompress(raw[a : a + int(e["size"])]), f"<u{step}")
            lo = hi


def read_document(uri: str, doc_id: int) -> list[np.ndarray]:
    """The ids of every row of one doc_id in a file: reads the footer, the index and those frames only."""
    import zstandard

    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        n, index, _ = TAIL.unpack(f.read_at(TAIL.size, f.size() - TAIL.size))
        _, _, step, sha = HEAD.unpack(f.read_at(HEAD.size, 0))
        entries = np.frombuffer(f.read_at(n * ENTRY.itemsize, index), ENTRY)
        with fs.open_input_file(f"{path.rpartition('/')[0]}/{sha.hex()}.dict") as d:
            dictionary = d.read()
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        lo, hi = np.searchsorted(entries["doc_id"], [doc_id, doc_id + 1])
        return [np.frombuffer(unzip.decompress(f.read_at(int(e["size"]), int(e["offset"]))), f"<u{step}") for e in entries[lo:hi]]


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            start, rows = row["base"], []
            for doc_id, ids in read_file(row["file"]):
                rows.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that a manifest lists."""
    dealt = manifest.select("file", "base").repartition(parts(spark), "file")
    return dealt.mapInArrow(_read_task, "doc_id long, start long, n_tokens long, ids_crc32 long")
