"""Whole frames as numpy matrices inside Arrow batches: masks, sums over the scan, and lists that are scattered to frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SCAN

#: A task sends its sums on once it holds those of so many data sets.
HELD = 64
#: Values that a task works on at a time: 8 MB of doubles, or one row if that is larger.
VALUES = 1 << 20


def matrices(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def by_shape(batch: pa.RecordBatch, h: int, w: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Parts of a batch whose extents (columns h and w) are equal, of VALUES values at most where a row is no larger."""
    sizes = np.stack([batch.column(h).to_numpy(), batch.column(w).to_numpy()], 1)
    shapes = list(dict.fromkeys(map(tuple, sizes.tolist())))
    for a, b in shapes:
        part = batch if len(shapes) == 1 else batch.take(pa.array(np.flatnonzero((sizes == (a, b)).all(1))))
        step = max(1, VALUES // max(1, a * b))
        for lo in range(0, len(part), step):
            yield part.slice(lo, step), a, b


def _mask_task(inside: Callable) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                if (h, w) not in masks:
                    y, x = np.divmod(np.arange(h * w), w)
                    masks[h, w] = np.flatnonzero(inside(y, x, h, w))
                total = matrices(part.column(5))[:, masks[h, w]].sum(1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(total)], names=[*SCAN, "value"])

    return task


def masked_sum(frames: DataFrame, inside: Callable) -> DataFrame:
    """Sum over the pixels for which inside(y, x, h, w) holds (arrays of pixels; built once a shape), a row a frame."""
    rows = frames.select(*SCAN, "det_h", "det_w", "counts")
    return rows.mapInArrow(_mask_task(inside), "dataset_id string, scan_y int, scan_x int, value long")


def _masks_task(inside: dict[str, Callable]) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                if (h, w) not in masks:
                    y, x = np.divmod(np.arange(h * w), w)
                    masks[h, w] = [np.flatnonzero(f(y, x, h, w)) for f in inside.values()]
                values = matrices(part.column(5))
                totals_ = [pa.array(values[:, m].sum(1, dtype=np.int64)) for m in masks[h, w]]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *totals_], names=[*SCAN, *inside])

    return task


def masked_sums(frames: DataFrame, inside: dict[str, Callable]) -> DataFrame:
    """masked_sum for several masks in one pass, a column each. Without state, so it works on streams as well."""
    rows = frames.select(*SCAN, "det_h", "det_w", "counts")
    return rows.mapInArrow(_masks_task(inside), "dataset_id string, scan_y int, scan_x int, " + ", ".join(f"`{n}` long" for n in inside))


Runs = list[tuple[int, int, int, float]]


def run_lengths(rows: list[tuple[int, int, float]]) -> Runs:
    """Pixels (y, x, weight) as runs in a row of equal weight: y, first x, x after the last, weight. Pixels given again add
    their weights."""
    weight: dict[tuple[int, int], float] = {}
    for y, x, w in rows:
        weight[y, x] = weight.get((y, x), 0) + w
    out: Runs = []
    for (y, x), w in sorted(weight.items()):
        if out and out[-1][0] == y and out[-1][2] == x and out[-1][3] == w:
            out[-1] = (*out[-1][:2], x + 1, w)
        else:
            out.append((y, x, x + 1, w))
    return out


def _runs_task(runs: Runs, whole: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                values = matrices(part.column(5)).astype(np.int64 if whole else float)
                total = np.zeros(len(part), values.dtype)
                for y, lo, hi, weight in runs:
                    lo, hi = max(lo, 0), min(hi, w)
                    if 0 <= y < h and lo < hi:
                        total += values[:, y * w + lo : y * w + hi].sum(1) * (int(weight) if whole else weight)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(total)], names=[*SCAN, "value"])

    return task


def weighted_runs(frames: DataFrame, runs: Runs, whole: bool) -> DataFrame:
    """Sums of frames over runs of pixels times their weights, a row a frame; nothing is shuffled."""
    kind = "long" if whole else "double"
    return frames.select(*SCAN, "det_h", "det_w", "counts").mapInArrow(_runs_task(runs, whole), f"dataset_id string, scan_y int, scan_x int, value {kind}")


def _sum_task(weights: Callable, kind: type) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def send() -> pa.RecordBatch:
            keys, lists = list(held), list(held.values())
            columns = [pa.array(c) for c in zip(*keys, strict=True)] if keys else [pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int32())]
            columns[1:] = [c.cast(pa.int32()) for c in columns[1:]]
            item = pa.int64() if kind is np.int64 else pa.float64()
            sums = [pa.array([s.tolist() for s in x], pa.list_(item)) for x in (zip(*(s for s, _ in lists), strict=True) if lists else [[], []])]
            return pa.RecordBatch.from_arrays([*columns, *sums, pa.array([n for _, n in lists], pa.int64())], names=["dataset_id", "det_h", "det_w", "a", "b", "n"])

        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                ids = np.array(part.column(0).to_pylist(), object)
                values = matrices(part.column(5)).astype(kind)
                pair = weights(values, part.column(1).to_numpy(), part.column(2).to_numpy())
                for id_ in dict.fromkeys(ids.tolist()):
                    mine = ids == id_
                    if (id_, h, w) not in held and len(held) >= HELD:
                        yield send()
                        held.clear()
                    entry = held.setdefault((id_, h, w), [[np.zeros(h * w, kind), np.zeros(h * w, kind)], 0])
                    entry[0] = [s + x(mine) for s, x in zip(entry[0], pair, strict=True)]
                    entry[1] += int(mine.sum())
        yield send()

    return task


def summed(frames: DataFrame, weights: Callable, kind: type = np.int64) -> DataFrame:
    """dataset_id, det_y, det_x, a, b, n: two sums over the scan for each pixel, and frames.

    Frames are added up inside a task; a pattern a task and data set is what moves. weights(values, scan_y, scan_x) gives
    for the two sums functions of a choice of rows."""
    item = "long" if kind is np.int64 else "double"
    rows = frames.select(*SCAN, "det_h", "det_w", "counts")
    sums = rows.mapInArrow(_sum_task(weights, kind), f"dataset_id string, det_h int, det_w int, a array<{item}>, b array<{item}>, n long")
    out = sums.select("dataset_id", "det_w", "n", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "s"))
    out = out.select("dataset_id", F.expr("cast(pos div det_w as int)").alias("det_y"), (F.col("pos") % F.col("det_w")).cast("int").alias("det_x"), "s.a", "s.b", "n")
    return out.groupBy("dataset_id", "det_y", "det_x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))


def totals(values: np.ndarray, scan_y: np.ndarray, scan_x: np.ndarray) -> tuple[Callable, Callable]:
    """For summed(): sums and sums of squares."""
    return (lambda mine: values[mine].sum(0)), (lambda mine: (values[mine] * values[mine]).sum(0))


def _scatter_task(names: list[str], item: pa.DataType) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(names)
            size = batch.column(n).fill_null(0).to_numpy().astype(np.int64)
            at, value = batch.column(n + 1), batch.column(n + 2)
            base = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(batch)), at.value_lengths().fill_null(0).to_numpy())
            place = at.flatten().to_numpy(zero_copy_only=False)
            inside = (place >= 0) & (place < size[owner])
            out = np.zeros(int(size.sum()), item.to_pandas_dtype())
            out[(base[owner] + place)[inside]] = value.flatten().fill_null(0).to_numpy(zero_copy_only=False)[inside]
            lists = pa.ListArray.from_arrays(pa.array(np.append(base, size.sum()).astype(np.int32)), pa.array(out, item))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], lists], names=[*names, "dense"])

    return task


def scattered(rows: DataFrame, size, at, value, item: str = "int") -> DataFrame:
    """rows with dense: a list of `size` items, 0 but at the places of the list `at`, where those of `value` stand. Linear in
    both; of equal places the last counts, places outside don't."""
    names = rows.columns
    wide = rows.select("*", size.cast("int").alias("_size"), at.cast("array<int>").alias("_at"), value.cast(f"array<{item}>").alias("_value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return wide.mapInArrow(_scatter_task(names, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[item]), f"{schema}, dense array<{item}>")
