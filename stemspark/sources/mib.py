"""Detector files of fixed-length frame records: each a text header of 384 or 768 bytes and big-endian pixels.

spark.read.format("mib").load(path) gives frames; option mode=header gives one row a file; the same format reads a
directory as a stream. A partition is a range of whole frames of one file. Filters on frame_idx, scan_y and scan_x
choose the frames that are read (spark.sql.python.filterPushdown.enabled must be true for that; with option
pushdown=false the reader doesn't offer it).

Files are opened where the tasks run, through pyarrow's filesystems: local paths and file://, hdfs:// and s3:// URIs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the format: pixel codes with their types, and places of the header's fields.
PIXELS = {"U08": np.dtype("u1"), "U16": np.dtype(">u2"), "U32": np.dtype(">u4")}
FIELD_HEADER, FIELD_WIDTH, FIELD_HEIGHT, FIELD_PIXEL, FIELD_CHIPS, FIELD_TIME, FIELD_DWELL, FIELD_KV = 2, 4, 5, 6, 7, 9, 10, 14
PARTITION_BYTES = 64 << 20

FRAMES = "dataset_id string, frame_idx bigint, scan_y int, scan_x int, det_h int, det_w int, counts array<bigint>, truncated boolean"
HEADERS = "dataset_id string, path string, file_size bigint, header_bytes int, det_h int, det_w int, pixel string, chips string, acquisition_time string, dwell string, kv string, n_frames bigint, tail_bytes bigint, compatible boolean, error string"


@dataclass
class Header:
    header_bytes: int
    det_h: int
    det_w: int
    pixel: str
    fields: list[str]

    @property
    def dtype(self) -> np.dtype:
        return PIXELS[self.pixel]

    @property
    def record(self) -> int:
        return self.header_bytes + self.det_h * self.det_w * self.dtype.itemsize


def parse_header(raw: bytes) -> Header:
    """The fields of a header; an error says what is wrong with it. A rectangular detector has its energy axis last."""
    fields = raw[:384].decode("utf-8", "replace").replace("\0", "").split(",")
    if len(fields) <= FIELD_PIXEL:
        raise ValueError("too few header fields")
    pixel = fields[FIELD_PIXEL].strip()
    if pixel not in PIXELS:
        raise ValueError(f"pixel type {pixel} can't be read")
    size, w, h = (int(fields[k]) for k in (FIELD_HEADER, FIELD_WIDTH, FIELD_HEIGHT))
    if min(size, w, h) < 1:
        raise ValueError("header sizes must be positive")
    return Header(size, min(h, w), max(h, w), pixel, [f.strip() for f in fields])


def scan_size(n: int) -> tuple[int, int]:
    """The factor pair of n with the least aspect ratio, the smaller first."""
    h = next((k for k in range(int(n**0.5), 0, -1) if n % k == 0), 0)
    return (h, n // h) if h else (0, 0)


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def files(path: str) -> list[str]:
    """The .mib files of a path: itself, those in a folder, or those that a * in its last part matches."""
    import fnmatch

    fs, inner = _fs(path)
    prefix = path.partition("://")[0] + "://" if "://" in path else ""
    name = os.path.basename(inner)
    if any(c in name for c in "*?["):
        found = fs.get_file_info(pa.fs.FileSelector(os.path.dirname(inner), allow_not_found=True))
        return sorted(prefix + f.path for f in found if f.type == pa.fs.FileType.File and fnmatch.fnmatch(f.base_name, name))
    info = fs.get_file_info(inner)
    if info.type == pa.fs.FileType.Directory:
        found = fs.get_file_info(pa.fs.FileSelector(inner))
        return sorted(prefix + f.path for f in found if f.type == pa.fs.FileType.File and f.base_name.lower().endswith(".mib"))
    if info.type != pa.fs.FileType.File:
        raise FileNotFoundError(path)
    return [prefix + inner]


def _head(path: str) -> tuple[int, bytes]:
    fs, inner = _fs(path)
    with fs.open_input_file(inner) as f:
        return f.size(), f.read_at(min(384, f.size()), 0)


def dataset_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


@dataclass
class Frames(InputPartition):
    path: str
    first: int
    count: int


@dataclass
class File(InputPartition):
    path: str


class _Reader:
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.bounds: dict[str, tuple[int, int]] = {}

    def _split(self, path: str) -> list[Frames]:
        size, raw = _head(path)
        head = parse_header(raw)
        whole = size // head.record
        n = whole + (size % head.record > 0)
        lo, hi = 0, n
        _, scan_w = scan_size(whole)
        for column, (a, b) in self.bounds.items():
            if column == "frame_idx":
                lo, hi = max(lo, a), min(hi, b + 1)
            elif column == "scan_y" and scan_w:
                lo, hi = max(lo, a * scan_w), min(hi, (b + 1) * scan_w)
        step = max(1, self.bytes // head.record)
        return [Frames(path, k, min(step, hi - k)) for k in range(lo, hi, step)]

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        size, raw = _head(part.path)
        head = parse_header(raw)
        whole = size // head.record
        _, scan_w = scan_size(whole)
        column = self.bounds.get("scan_x")
        pixels = head.det_h * head.det_w
        fs, inner = _fs(part.path)
        step = max(1, (4 << 20) // head.record)
        with fs.open_input_file(inner) as f:
            for lo in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - lo)
                data = f.read_at(min(n * head.record, size - lo * head.record), lo * head.record)
                index, rows, cut = [], [], []
                for k in range(n):
                    if column and scan_w and not column[0] <= (lo + k) % scan_w <= column[1]:
                        continue
                    body = data[k * head.record + head.header_bytes : (k + 1) * head.record]
                    short = len(body) < pixels * head.dtype.itemsize
                    if short:
                        body = body.ljust(pixels * head.dtype.itemsize, b"\0")
                    index.append(lo + k)
                    rows.append(np.frombuffer(body, head.dtype).astype(np.int64))
                    cut.append(short)
                if not index:
                    continue
                at = np.array(index)
                w = max(1, scan_w)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * pixels, pa.int32()), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dataset_name(part.path)] * len(at)),
                        pa.array(at),
                        pa.array((at // w).astype(np.int32)),
                        pa.array((at % w).astype(np.int32)),
                        pa.array(np.full(len(at), head.det_h, np.int32)),
                        pa.array(np.full(len(at), head.det_w, np.int32)),
                        values,
                        pa.array(cut),
                    ],
                    names=["dataset_id", "frame_idx", "scan_y", "scan_x", "det_h", "det_w", "counts", "truncated"],
                )


class FrameReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Frames]:
        return [p for path in files(self.path) for p in self._split(path)]


class PushingReader(FrameReader):
    """A reader that takes ranges of frame_idx, scan_y and scan_x; Spark filters the rows again."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("frame_idx", "scan_y", "scan_x") and isinstance(getattr(f, "value", None), int):
                lo, hi = self.bounds.get(column, (0, 1 << 62))
                if isinstance(f, EqualTo):
                    lo, hi = max(lo, f.value), min(hi, f.value)
                elif isinstance(f, GreaterThanOrEqual):
                    lo = max(lo, f.value)
                elif isinstance(f, GreaterThan):
                    lo = max(lo, f.value + 1)
                elif isinstance(f, LessThanOrEqual):
                    hi = min(hi, f.value)
                elif isinstance(f, LessThan):
                    hi = min(hi, f.value - 1)
                self.bounds[column] = (lo, hi)
            yield f


class HeaderReader(DataSourceReader):
    """One row a file, without pixels; a file that can't be read is a row that says why."""

    def __init__(self, options: dict):
        self.path = options.get("path", "")

    def partitions(self) -> list[File]:
        return [File(p) for p in files(self.path)]

    def read(self, part: File):
        size, raw = _head(part.path)
        try:
            h = parse_header(raw)
        except ValueError as e:
            yield (dataset_name(part.path), part.path, size, None, None, None, None, None, None, None, None, None, None, False, str(e))
            return
        at = lambda k: h.fields[k] if k < len(h.fields) else None
        yield (dataset_name(part.path), part.path, size, h.header_bytes, h.det_h, h.det_w, h.pixel, at(FIELD_CHIPS), at(FIELD_TIME), at(FIELD_DWELL), at(FIELD_KV), size // h.record, size % h.record, True, None)


class FrameStream(_Reader, DataSourceStreamReader):
    """A folder to which files are added: an offset holds the names seen; each file is read once."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": []}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        old = set(start["files"])
        return [p for path in end["files"] if path not in old for p in self._split(path)]

    def commit(self, end: dict) -> None:
        pass


class MibDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mib"

    def schema(self) -> str:
        return HEADERS if self.options.get("mode") == "header" else FRAMES

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("mode") == "header":
            return HeaderReader(self.options)
        return FrameReader(self.options) if self.options.get("pushdown", "true") == "false" else PushingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FrameStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let its readers take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MibDataSource)


def _write_task(folder: str, pixel: str, header_bytes: int):
    def task(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["frame_idx"])
        name, h, w = rows[0]["file"], rows[0]["det_h"], rows[0]["det_w"]
        fs, inner = _fs(f"{folder}/{name}.mib")
        with fs.open_output_stream(inner, compression=None) as f:
            for k, r in enumerate(rows):
                head = f"HDR,{k + 1:06d},{header_bytes:05d},01,{w:04d},{h:04d},{pixel},1x1,01,2024-01-01 00:00:00.000000,0.001000,0,0,0,200"
                f.write(head.encode().ljust(header_bytes, b"\0"))
                f.write(np.array(r["counts"]).astype(PIXELS[pixel]).tobytes())
        return pa.table({"file": [name], "n_frames": pa.array([len(rows)], pa.int64())})

    return task


def write_mib(frames, folder: str, frames_per_file: int, pixel: str = "U16", header_bytes: int = 384):
    """frames as detector files of frames_per_file frames each (part-0.mib and on); the names and counts of the files.

    A task holds one file's frames, so frames_per_file bounds its memory."""
    from pyspark.sql import functions as F

    fs, inner = _fs(folder)
    fs.create_dir(inner, recursive=True)
    name = F.concat(F.lit("part-"), F.expr(f"cast(frame_idx div {frames_per_file} as string)"))
    rows = frames.select(name.alias("file"), "frame_idx", "det_h", "det_w", "counts")
    return rows.groupBy("file").applyInArrow(_write_task(folder, pixel, header_bytes), "file string, n_frames bigint")


def _copy_task(folder: str):
    def task(batches):
        fs, at = _fs(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
                    f.write(content)
            yield batch.select([0])

    return task


def write_files(files, folder: str):
    """Files (name, content) as they are, under a folder; returns their names once they are written."""
    return files.select("name", "content").mapInArrow(_copy_task(folder), "name string")
