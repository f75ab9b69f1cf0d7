"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that stand alone; a bundle ends with the seek table of the seekable format (a
skippable frame with the sizes of all frames), so any record is read by its frame and its offset in it. Of records
with equal payloads of MIN_REVISIT bytes or more, the one with the greatest id holds the payload, the others revisit
it.

Defined results: a null payload is empty; a null url gives a record without a target; rows with a null id are
responses or revisits as any other, and take part in the choice of a response only if all their equals have null
ids; rows of one id are records of their own, and every row with the greatest id is a response; ids that are no
integers are refused; an empty table gives no bundles; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import spread_join
from .store import fresh, kept, long_id, parts

MIN_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 64 << 20, 5
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    told = urn[len("<urn:x-page:") : -1]
    return int(told) if told else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: the WARC header, then an HTTP response whose body is left out in a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block, and where the next record starts."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    begin = stop + 4
    end = begin + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record's end is missing")
    return fields, data[begin:end], end + 4


class _Bundle:
    def __init__(self, folder: str):
        import zstandard

        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = pa.fs.FileSystem.from_uri(self.name)
        self.out = fs.open_output_stream(path, compression=None)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame and offset in it of a record."""
        if self.held and self.size + len(raw) > FRAME_BYTES:
            self._flush()
        at = len(self.frames), self.size
        self.held.append(raw)
        self.size += len(raw)
        return at

    def _flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.out.close()


_INDEX = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("size", pa.int64())])


def _write_task(folder: str) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for page_id, url, html, digest, leader, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = _Bundle(folder)
                raw = record(page_id, url, (html or "").encode(), bytes.fromhex(digest), leader, revisit)
                rows.append((page_id, bundle.name, *bundle.add(raw), len(raw)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)] if rows else [pa.array([], f.type) for f in _INDEX], schema=_INDEX)
        if bundle is not None:
            bundle.close()

    return task


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as bundles; returns the index: page_id, file, frame, offset (in it), size.

    The choice of responses is a greatest id for each digest, summed before the shuffle; joined back, a digest that
    many pages share is dealt over all partitions. A task that runs twice writes other names."""
    spark = pages.sparkSession
    folder = folder or fresh(spark, "warc")
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(long_id(pages, "page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    leaders = rows.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("copies"))
    leaders = kept(leaders.where("copies > 1"), "responses")
    rows = spread_join(rows, leaders, ["digest"], leaders.select("digest", F.col("copies").alias("n")), "left")
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    rows = rows.select("page_id", "url", "html", "digest", "leader", revisit.alias("revisit"))
    return kept(rows.mapInArrow(_write_task(folder), "page_id long, file string, frame int, offset long, size long"), "warc_index")


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """Offset, compressed bytes and bytes of every frame of a bundle."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        raw, at, out = f.read_at(8 * n, size - 9 - 8 * n), 0, []
        for packed, full in struct.iter_unpack("<II", raw):
            out.append((at, packed, full))
            at += packed
        return out


def read_record(uri: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record: reads the seek table and one frame."""
    import zstandard

    at, packed, full = seek_table(uri)[frame]
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=full)
    fields, block, _ = parse(data, offset)
    return fields, block


_READ = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of frames (file, frame); a file's seek table is read once a task."""
    import zstandard

    schema, tables = pa.schema(_READ), {}
    for batch in batches:
        for uri, frame in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if uri not in tables:
                tables[uri] = seek_table(uri)
            start, packed, full = tables[uri][frame]
            fs, path = pa.fs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                data, at, rows = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=full), 0, []
            while at < len(data):
                fields, block, at = parse(data, at)
                head, _, body = block.partition(b"\r\n\r\n")
                n = int(head.rpartition(b"Content-Length: ")[2])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
                    raise ValueError(f"a payload in {uri} isn't what its header says")
                rows.append((_page(fields["WARC-Record-ID"]), n, digest, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None, fields.get("WARC-Target-URI")))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_READ)], schema=schema)


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record of the bundles in an index.

    Frames, not files, are dealt, and over all partitions: each is read by itself through its file's seek table."""
    frames = index.select("file", "frame").distinct().repartition(parts(spark))
    return frames.mapInArrow(_read_task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
