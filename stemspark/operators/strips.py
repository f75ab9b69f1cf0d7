"""Transforms over scans of which one image is too large for a task: strips of lines, transposed by a shuffle.

A strip holds some whole lines of a detector pixel's image: rows of the scan (axis "y") or columns (axis "x"). A pass
works on the lines of each strip, cuts the strip into blocks of the other axis, deals the blocks by their place there, and works
on the lines of the strips that they make. So a transform over both axes takes one shuffle of the image, and a task
holds one strip at a time (LINES lines, or fewer of those that are longer than VALUES / LINES).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .align import gauss_kernel
from .dense import matrices

STRIPS = "dataset_id string, det_y int, det_x int, scan_h int, scan_w int, axis string, at int, data binary"
_SCHEMA = pa.schema([("dataset_id", pa.string()), ("det_y", pa.int32()), ("det_x", pa.int32()), ("scan_h", pa.int32()), ("scan_w", pa.int32()), ("axis", pa.string()), ("at", pa.int32()), ("data", pa.binary())])
#: Values of a strip: 8 MB of complex numbers.
VALUES = 1 << 19

Line = Callable[[np.ndarray], np.ndarray]


def lines_of(length: int, lines: int = 0) -> int:
    """How many lines of a length a strip has, where the caller doesn't say."""
    return lines or max(1, VALUES // max(1, length))


def fft_line(values: np.ndarray) -> np.ndarray:
    return np.fft.fft(values, axis=1)


def ifft_line(values: np.ndarray) -> np.ndarray:
    return np.fft.ifft(values, axis=1)


def smooth_line(sigma: float) -> Line:
    """A Gaussian to four sigmas along each line, mirrored at its ends."""
    kernel = gauss_kernel(sigma)
    r = len(kernel) // 2

    def smooth(values: np.ndarray) -> np.ndarray:
        wide = np.pad(values, ((0, 0), (r, r)), "symmetric")
        return sum(weight * wide[:, d + r : d + r + values.shape[1]] for d, weight in kernel)

    return smooth


def _cut_task(scan_h: int, scan_w: int, rows: int) -> Callable:
    """Frames to tiles of (detector pixels x frames of one strip), in doubles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            frame, width = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            strip = frame // (rows * scan_w)
            inside = (frame >= 0) & (frame < scan_h * scan_w)
            out = []
            for id_, s in dict.fromkeys(zip(ids[inside].tolist(), strip[inside].tolist(), strict=True)):
                which = np.flatnonzero((ids == id_) & (strip == s) & inside)
                tile = matrices(batch.column(3).take(pa.array(which))).astype(float).T
                place = (frame[which] - s * rows * scan_w).astype("<i8").tobytes()
                out += [(id_, int(p // width[which[0]]), int(p % width[which[0]]), int(s), place, v.tobytes()) for p, v in enumerate(tile)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["dataset_id", "det_y", "det_x", "strip", "place", "part"])

    return task


def _one(row: dict, h: int, w: int, axis: str, at: int, values: np.ndarray) -> pa.Table:
    columns = [row["dataset_id"], row["det_y"], row["det_x"], h, w, axis, at, np.ascontiguousarray(values, complex).tobytes()]
    return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def row_strips(frames: DataFrame, scan_h: int, scan_w: int, rows: int = 0) -> DataFrame:
    """STRIPS of `rows` scan rows of every detector pixel; positions without a frame are 0, of equal ones the last counts."""
    rows = lines_of(scan_w, rows)

    def join(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        n = min(rows, scan_h - first["strip"] * rows)
        values = np.zeros(n * scan_w)
        for place, part in zip(table.column("place").to_pylist(), table.column("part").to_pylist(), strict=True):
            values[np.frombuffer(place, "<i8")] = np.frombuffer(part)
        return _one(first, scan_h, scan_w, "y", first["strip"] * rows, values)

    tiles = frames.select("dataset_id", "frame_idx", "det_w", "counts").mapInArrow(_cut_task(scan_h, scan_w, rows), "dataset_id string, det_y int, det_x int, strip int, place binary, part binary")
    return tiles.groupBy("dataset_id", "det_y", "det_x", "strip").applyInArrow(join, STRIPS)


def _lines(row: dict) -> np.ndarray:
    """A strip's lines as rows of a matrix."""
    return np.frombuffer(row["data"], complex).reshape(-1, row["scan_w"] if row["axis"] == "y" else row["scan_h"])


def passed(strips: DataFrame, before: Line | None = None, after: Line | None = None, lines: int = 0) -> DataFrame:
    """Strips along the other axis: `before` works on the lines as they are, `after` on those of the new strips, of which each
    has `lines` lines. One shuffle; neither may change the length of a line. Where the strips come with those of another
    image (`ref`), they are multiplied by its conjugate first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                values = _lines(row)
                values = values * np.conj(_lines(row | {"data": row["ref"]})) if "ref" in row else values
                values = before(values) if before else values
                step = lines_of(row["scan_h"] if row["axis"] == "y" else row["scan_w"], lines)
                at = range(0, values.shape[1], step)
                blocks = [np.ascontiguousarray(values[:, k : k + step]).tobytes() for k in at]
                same = [pa.array([row[f.name]] * len(at), f.type) for f in list(_SCHEMA)[:7]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at, pa.int32()), pa.array(blocks, pa.binary())], names=[*_SCHEMA.names[:7], "to", "block"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        row = table.slice(0, 1).drop_columns(["block"]).to_pylist()[0]
        other = "x" if row["axis"] == "y" else "y"
        length, count = (row["scan_h"], row["scan_w"]) if other == "x" else (row["scan_w"], row["scan_h"])
        width = min(lines_of(length, lines), count - row["to"])
        values = np.concatenate([np.frombuffer(b.as_buffer(), complex).reshape(-1, width) for b in table.column("block")]).T
        return _one(row, row["scan_h"], row["scan_w"], other, row["to"], after(values) if after else values)

    blocks = strips.mapInArrow(cut, STRIPS.rsplit(",", 1)[0] + ", to int, block binary")
    return blocks.groupBy("dataset_id", "det_y", "det_x", "to").applyInArrow(join, STRIPS)


def fft_strips(strips: DataFrame, lines: int = 0) -> DataFrame:
    """The transform over both axes, as strips of the other axis."""
    return passed(strips, fft_line, fft_line, lines)


def ifft_strips(strips: DataFrame, lines: int = 0) -> DataFrame:
    return passed(strips, ifft_line, ifft_line, lines)


def smooth_strips(strips: DataFrame, sigma: float, lines: int = 0) -> DataFrame:
    """Images smoothed along both axes, as strips of the same axis."""
    smooth = smooth_line(sigma)
    return passed(passed(strips, smooth, smooth, lines), None, None, lines)


def strip_rows(strips: DataFrame) -> DataFrame:
    """dataset_id, det_y, det_x, y, x, re, im: a row a value."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                values = _lines(row)
                line, place = np.indices(values.shape)
                y, x = (line + row["at"], place) if row["axis"] == "y" else (place, line + row["at"])
                same = [pa.repeat(pa.scalar(row[c], t), values.size) for c, t in (("dataset_id", pa.string()), ("det_y", pa.int32()), ("det_x", pa.int32()))]
                columns = [pa.array(c.ravel().astype(np.int32)) for c in (y, x)] + [pa.array(np.ascontiguousarray(c.ravel())) for c in (values.real, values.imag)]
                yield pa.RecordBatch.from_arrays([*same, *columns], names=["dataset_id", "det_y", "det_x", "y", "x", "re", "im"])

    return strips.mapInArrow(task, "dataset_id string, det_y int, det_x int, y int, x int, re double, im double")


def energy(strips: DataFrame) -> DataFrame:
    """dataset_id, det_y, det_x, energy: the sum of squares of each image."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [float((np.abs(np.frombuffer(d.as_buffer(), complex)) ** 2).sum()) for d in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total, pa.float64())], names=["dataset_id", "det_y", "det_x", "energy"])

    rows = strips.select("dataset_id", "det_y", "det_x", "data").mapInArrow(task, "dataset_id string, det_y int, det_x int, energy double")
    return rows.groupBy("dataset_id", "det_y", "det_x").agg(F.sum("energy").alias("energy"))


def correlate_strips(strips: DataFrame, reference: DataFrame, lines: int = 0) -> DataFrame:
    """Normalised squared circular correlations with the data set's reference (strips of one image a data set, of the same
    axis), a row a lag: dataset_id, det_y, det_x, lag_y, lag_x, corr, zero lag in the middle."""

    ref = fft_strips(reference, lines).select("dataset_id", "at", F.col("data").alias("ref"))
    both = fft_strips(strips, lines).join(ref, ["dataset_id", "at"]).select(*_SCHEMA.names, "ref")
    found = strip_rows(ifft_strips(both, lines)).drop("im")
    size = strips.select("dataset_id", "scan_h", "scan_w").distinct()
    norm = energy(strips).join(energy(reference).select("dataset_id", F.col("energy").alias("other")), "dataset_id").join(size, "dataset_id")
    norm = norm.withColumn("norm", F.when(F.col("energy") * F.col("other") < 1e-9, 1.0).otherwise(F.col("energy") * F.col("other")))
    lag = lambda c, n: F.pmod(F.col(c) + F.expr(f"int({n} div 2)"), F.col(n)).alias(f"lag_{c}")
    norm = kept(norm.drop("energy", "other"), "norm")  # a row a detector pixel; lags aren't moved to join a table that is known to be small
    found = found.join(norm, ["dataset_id", "det_y", "det_x"])
    return found.select("dataset_id", "det_y", "det_x", lag("y", "scan_h"), lag("x", "scan_w"), (F.col("re") * F.col("re") / F.col("norm")).alias("corr"))
