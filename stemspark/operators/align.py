"""Shift maps by cross-correlation, their distortion, and reconstructions on finer grids.

Images of detector pixels come as rows of layout.pixel_images. Shifts name the axis: shift_y along scan_y.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import poly_terms
from ..schemas import PIXEL_IMAGES, SHIFTS
from .dense import by_shape, matrices
from .spectral import lists

_AT = ["dataset_id", "det_y", "det_x"]


# --- smoothing -------------------------------------------------------------------------------------------------------


def gauss_kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights to four sigmas; they sum to 1."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k - r, x / sum(w)) for k, x in enumerate(w)]


def _smooth_task(sigma: float, truncate_int: bool) -> Callable:
    kernel = gauss_kernel(sigma)
    r = len(kernel) // 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                v = matrices(part.column(5)).astype(float).reshape(-1, h, w)
                wide = np.pad(v, ((0, 0), (r, r), (0, 0)), "symmetric")  # mirrored ends, the end place repeated
                v = sum(weight * wide[:, d + r : d + r + h] for d, weight in kernel)
                wide = np.pad(v, ((0, 0), (0, 0), (r, r)), "symmetric")
                v = sum(weight * wide[:, :, d + r : d + r + w] for d, weight in kernel)
                v = np.floor(v) if truncate_int else v
                yield pa.RecordBatch.from_arrays([*part.columns[:5], lists(v.reshape(len(part), -1))], names=[*_AT, "scan_h", "scan_w", "img"])

    return task


def gaussian_smooth(images: DataFrame, sigma: float = 0.5, truncate_int: bool = False) -> DataFrame:
    """Images smoothed along both axes, in doubles; truncate_int cuts the results to whole numbers."""
    return images.select(*_AT, "scan_h", "scan_w", "img").mapInArrow(_smooth_task(sigma, truncate_int), PIXEL_IMAGES)


def centre_reference(images: DataFrame, sigma: float = 0.5, at: tuple[int, int] | None = None) -> DataFrame:
    """dataset_id, ref: the smoothed image of the pixel in the middle of the detector region.

    Where the caller knows that pixel, it is given as `at` and filtered in the scan of the images."""
    if at:
        one = images.where((F.col("det_y") == at[0]) & (F.col("det_x") == at[1]))
    else:
        size = images.groupBy("dataset_id").agg(F.expr("cast((max(det_y) + min(det_y) + 1) div 2 as int)").alias("det_y"), F.expr("cast((max(det_x) + min(det_x) + 1) div 2 as int)").alias("det_x"))
        one = images.join(size, _AT)
    return gaussian_smooth(one, sigma).select("dataset_id", F.col("img").alias("ref"))


# --- correlation -----------------------------------------------------------------------------------------------------


def _correlate(values: np.ndarray, ref: np.ndarray, h: int, w: int) -> np.ndarray:
    """Normalised squared circular correlations of images with one reference, zero lag in the middle."""
    c = np.fft.irfft2(np.fft.rfft2(values.reshape(-1, h, w)) * np.conj(np.fft.rfft2(ref.reshape(h, w))), s=(h, w))
    norm = (ref**2).sum() * (values**2).sum(1)
    norm[norm < 1e-9] = 1
    return np.fft.fftshift(c**2 / norm[:, None, None], axes=(1, 2))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images = [r.values.to_numpy(zero_copy_only=False).astype(float).tobytes() for r in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["dataset_id", "ref"])


def _with_reference(images: DataFrame, reference: DataFrame) -> DataFrame:
    """One reference image a data set: as many rows as data sets; whether it is broadcast goes by its size.

    It is repeated with each image, so it goes as bytes, which Spark hands on without a step for each value."""
    rows = images.select(*_AT, "scan_h", "scan_w", "img")
    packed = reference.where(F.col("ref").isNotNull()).select("dataset_id", "ref").mapInArrow(_packed, "dataset_id string, ref binary")
    return rows.join(packed, "dataset_id")


def _per_reference(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    ids = np.array(part.column(0).to_pylist(), object)
    for id_ in dict.fromkeys(ids.tolist()):
        mine = ids == id_
        some = part if mine.all() else part.take(pa.array(np.flatnonzero(mine)))
        yield some, np.frombuffer(some.column(6)[0].as_buffer())


def _correlation_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, h, w in by_shape(batch, 3, 4):
            for some, ref in _per_reference(part):
                c = _correlate(matrices(some.column(5)).astype(float), ref, h, w)
                yield pa.RecordBatch.from_arrays([*some.columns[:5], lists(c.reshape(len(some), -1))], names=[*_AT, "scan_h", "scan_w", "corr"])


def cross_correlate(images: DataFrame, reference: DataFrame) -> DataFrame:
    """corr: for each detector pixel the correlation with its data set's reference at every lag, zero in the middle."""
    return _with_reference(images, reference).mapInArrow(_correlation_task, "dataset_id string, det_y int, det_x int, scan_h int, scan_w int, corr array<double>")


def correlation_rows(correlations: DataFrame) -> DataFrame:
    out = correlations.select(*_AT, "scan_h", "scan_w", F.posexplode("corr").alias("k", "corr"))
    return out.select(*_AT, "scan_h", "scan_w", F.expr("cast(k div scan_w as int)").alias("lag_y"), (F.col("k") % F.col("scan_w")).cast("int").alias("lag_x"), "corr")


def _best_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each detector pixel's lags in a batch the first greatest; as in Spark NaN is the greatest value and null the least."""
    for batch in batches:
        pixel = [batch.column(k).dictionary_encode("encode").indices.to_numpy() for k in range(5)]
        w, y, x, corr = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4, 8))
        kind = np.where(batch.column(7).is_null().to_numpy(zero_copy_only=False), 2, ~np.isnan(corr))
        order = np.lexsort((y * w + x, -np.where(kind == 1, corr, 0), kind, *pixel))
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(p[order]) != 0 for p in pixel], 0)
        yield batch.take(pa.array(order[new]))


def peak_argmax(rows: DataFrame) -> DataFrame:
    """The first greatest lag of each detector pixel, row by row. Batches of lags are reduced before they are grouped, as the
    greatest struct of a group is found by sorting its rows."""
    rows = rows.select(*_AT, "scan_h", "scan_w", "lag_y", "lag_x", "corr")
    flat = F.col("lag_y") * F.col("scan_w") + F.col("lag_x")
    best = rows.mapInArrow(_best_task, rows.schema).groupBy(*_AT, "scan_h", "scan_w").agg(F.max(F.struct(F.col("corr"), (-flat).alias("order"), "lag_y", "lag_x")).alias("p"))
    return best.select(*_AT, "scan_h", "scan_w", F.col("p.lag_y").alias("peak_y"), F.col("p.lag_x").alias("peak_x"), F.col("p.corr").alias("peak"))


def peak_neighbourhood(rows: DataFrame, peaks: DataFrame, diagonal: bool = False) -> DataFrame:
    """peaks with the values about them: up, down, left, right (and the corners n_dy_dx); null outside the map."""
    offsets = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}
    if diagonal:
        offsets |= {f"c{dy + 1}{dx + 1}": (dy, dx) for dy in (-1, 1) for dx in (-1, 1)}
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (F.col("peak_y") + dy).alias("lag_y"), (F.col("peak_x") + dx).alias("lag_x")) for n, (dy, dx) in offsets.items()))).alias("o")
    wanted = peaks.select(*_AT, places).select(*_AT, "o.*")
    found = wanted.join(rows.select(*_AT, "lag_y", "lag_x", "corr"), [*_AT, "lag_y", "lag_x"])
    wide = found.groupBy(*_AT).agg(*(F.max(F.when(F.col("name") == n, F.col("corr"))).alias(n) for n in offsets))
    return peaks.join(wide, _AT, "left")


def _inside() -> Column:
    return F.col("peak_y").between(1, F.col("scan_h") - 2) & F.col("peak_x").between(1, F.col("scan_w") - 2)


def subpixel_quadratic(near: DataFrame) -> DataFrame:
    """Shifts from parabolas through the peak and its neighbours on each axis; at the border the peak itself.

    A second difference above 1e-3 counts as 1e6; where it is 0 the peak stays."""

    def refined(at: str, before: str, after: str) -> Column:
        d, dd = F.col(after) - F.col(before), F.col(after) - 2 * F.col("peak") + F.col(before)
        den = F.when(dd <= 1e-3, dd).otherwise(F.lit(1e6))
        step = F.coalesce(F.try_divide(d, den), F.lit(0.0)) / 2
        return F.when(_inside(), F.col(at) - step).otherwise(F.col(at).cast("double"))

    return near.select(*_AT, refined("peak_y", "up", "down").alias("shift_y"), refined("peak_x", "left", "right").alias("shift_x"), F.col("peak").alias("quality"))


def subpixel_lstsq(near: DataFrame) -> DataFrame:
    """Shifts from the least-squares paraboloid over the 3 x 3 patch, in closed form; at the border the peak itself."""
    n = {(dy, dx): F.col(c) for c, (dy, dx) in {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1), "peak": (0, 0), "c00": (-1, -1), "c02": (-1, 1), "c20": (1, -1), "c22": (1, 1)}.items()}
    total = lambda f: sum((f(y, x) * v for (y, x), v in n.items() if f(y, x)), F.lit(0.0))
    a = total(lambda y, x: 3 * x * x - 2) / 6
    b = total(lambda y, x: 3 * y * y - 2) / 6
    c = total(lambda y, x: x * y) / 4
    d, e = total(lambda y, x: x) / 6, total(lambda y, x: y) / 6
    det = F.nullif(4 * a * b - c * c, F.lit(0.0))
    ox, oy = (-2 * b * d + c * e) / det, (-2 * a * e + c * d) / det
    pick = lambda at, o: F.when(_inside(), F.col(at) + F.coalesce(o, F.lit(0.0))).otherwise(F.col(at).cast("double"))
    return near.select(*_AT, pick("peak_y", oy).alias("shift_y"), pick("peak_x", ox).alias("shift_x"), F.col("peak").alias("quality"))


def _shift_task(subpixel: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                for some, ref in _per_reference(part):
                    c = _correlate(matrices(some.column(5)).astype(float), ref, h, w)
                    n, at = np.arange(len(some)), c.reshape(len(some), -1).argmax(1)
                    y, x = at // w, at % w
                    peak = c[n, y, x]
                    shift_y, shift_x = y.astype(float), x.astype(float)
                    if subpixel:
                        k = np.flatnonzero((y >= 1) & (y < h - 1) & (x >= 1) & (x < w - 1))
                        for shift, dy, dx in ((shift_y, 1, 0), (shift_x, 0, 1)):
                            before, after = c[k, y[k] - dy, x[k] - dx], c[k, y[k] + dy, x[k] + dx]
                            dd = after - 2 * peak[k] + before
                            dd[dd > 1e-3] = 1e6
                            shift[k] -= np.divide(after - before, dd, out=np.zeros(len(k)), where=dd != 0) / 2
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(shift_y), pa.array(shift_x), pa.array(peak)], names=[*_AT, "shift_y", "shift_x", "quality"])

    return task


def shift_maps(images: DataFrame, reference: DataFrame, subpixel: bool = True) -> DataFrame:
    """Correlation, peak and refinement in one task: one row leaves it for each detector pixel."""
    return _with_reference(images, reference).mapInArrow(_shift_task(subpixel), SHIFTS)


def center_shifts(shifts: DataFrame, scan_h: int, scan_w: int) -> DataFrame:
    """Shifts relative to zero lag."""
    return shifts.withColumns({"shift_y": F.col("shift_y") - scan_h // 2, "shift_x": F.col("shift_x") - scan_w // 2})


def center_shifts_on_pixel(shifts: DataFrame) -> DataFrame:
    """Shifts relative to that of the pixel in the middle: one row a data set."""
    mid = shifts.groupBy("dataset_id").agg(F.expr("cast((max(det_y) + 1) div 2 as int)").alias("det_y"), F.expr("cast((max(det_x) + 1) div 2 as int)").alias("det_x"))
    at = shifts.join(mid, _AT).select("dataset_id", F.col("shift_y").alias("y0"), F.col("shift_x").alias("x0"))
    return shifts.join(at, "dataset_id").withColumns({"shift_y": F.col("shift_y") - F.col("y0"), "shift_x": F.col("shift_x") - F.col("x0")}).drop("y0", "x0")


# --- distortion ------------------------------------------------------------------------------------------------------


def fit_moments(shifts: DataFrame, order: int, u0: float, v0: float, intercept: bool = True, weight: Column | None = None, weight_power: int = 1) -> DataFrame:
    """Sums of the normal equations, one row a data set: m_i_j, y_i, x_i. At most 21 terms. They are good for comparison and
    low orders; fit_distortion solves from a QR."""
    terms = poly_terms(F.col("det_y") - u0, F.col("det_x") - v0, order, intercept)
    w = F.pow(F.greatest(weight if weight is not None else F.lit(1.0), F.lit(0.0)) + 1e-12, F.lit(weight_power))
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"m_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    sums += [F.sum(w * t * F.col(c)).alias(f"{n}_{i}") for n, c in (("y", "shift_y"), ("x", "shift_x")) for i, t in enumerate(terms)]
    return shifts.groupBy("dataset_id").agg(*sums)


def _design(u: np.ndarray, v: np.ndarray, order: int, intercept: bool) -> np.ndarray:
    """The columns of scalar.poly_terms as a matrix."""
    return np.stack([u ** (degree - b) * v**b for degree in range(0 if intercept else 1, order + 1) for b in range(degree + 1)], 1)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The triangle of a QR of some rows, square even where there are fewer rows than columns. Triangles of parts, put one
    under the other, have the triangle of the whole."""
    r = np.linalg.qr(rows, mode="r")
    return np.pad(r, ((0, rows.shape[1] - len(r)), (0, 0)))


def _triangle_task(order: int, u0: float, v0: float, intercept: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, np.ndarray] = {}
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            y, x, *values, w = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(1, 6))
            rows = np.column_stack([_design(y - u0, x - v0, order, intercept), *values]) * w[:, None]
            for id_ in dict.fromkeys(ids.tolist()):
                mine = rows[[i == id_ for i in ids.tolist()]]
                found[id_] = _triangle(np.concatenate([found[id_], mine]) if id_ in found else mine)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([r.ravel().tolist() for r in found.values()], pa.list_(pa.float64()))], names=["dataset_id", "part", "r"]
        )

    return task


def _stacked(table: pa.Table, k: int) -> np.ndarray:
    return _triangle(np.array(table.column("r").to_pylist()).reshape(-1, k))


def fit_triangles(shifts: DataFrame, order: int, u0: float, v0: float, intercept: bool = True, weight: Column | None = None, weight_power: int = 1) -> DataFrame:
    """dataset_id, r: the triangle of a QR of the weighted terms (columns) with shift_y and shift_x, one row a data set.

    Each task makes one of its rows, batch by batch; those of up to GROUPED tasks are put together first and then all."""
    w = F.sqrt(F.pow(F.greatest(weight if weight is not None else F.lit(1.0), F.lit(0.0)) + 1e-12, F.lit(weight_power)))
    rows = shifts.select(*_AT, "shift_y", "shift_x", w.alias("w")).dropna(subset=["det_y", "det_x", "shift_y", "shift_x", "w"])
    k = (order + 1) * (order + 2) // 2 - (0 if intercept else 1) + 2
    each = rows.mapInArrow(_triangle_task(order, u0, v0, intercept), "dataset_id string, part int, r array<double>")

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"dataset_id": table.column("dataset_id")[:1], "r": pa.array([_stacked(table, k).ravel().tolist()], pa.list_(pa.float64()))})

    some = each.groupBy("dataset_id", F.expr(f"part div {GROUPED}").alias("group")).applyInArrow(merged, "dataset_id string, r array<double>")
    return some.groupBy("dataset_id").applyInArrow(merged, "dataset_id string, r array<double>")


#: Triangles (23 x 23 numbers at most) that one task puts together.
GROUPED = 256


def _solve_task(k: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = np.array(r).reshape(k + 2, k + 2)
                size = np.linalg.norm(r[:k, :k], axis=0)
                size[size == 0] = 1
                c = np.linalg.lstsq(r[:k, :k] / size, r[:k, k:], rcond=1e-13)[0] / size[:, None]
                rows += [(id_, i, float(cy), float(cx)) for i, (cy, cx) in enumerate(c)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["dataset_id", "term", "coef_y", "coef_x"])

    return task


def fit_distortion(shifts: DataFrame, order: int, u0: float, v0: float, intercept: bool = True, weight: Column | None = None, weight_power: int = 1) -> DataFrame:
    """dataset_id, term, coef_y, coef_x of a weighted polynomial fit of the shifts over the detector, from a QR of the
    weighted terms (their squares, in normal equations, lose the fine terms). Rows with a null place, shift or weight
    don't count; where there are too few places for the terms, the smallest coefficients are taken."""
    k = (order + 1) * (order + 2) // 2 - (0 if intercept else 1)
    return fit_triangles(shifts, order, u0, v0, intercept, weight, weight_power).mapInArrow(_solve_task(k), "dataset_id string, term int, coef_y double, coef_x double")


def distortion_residuals(shifts: DataFrame, coefficients: DataFrame, order: int, u0: float, v0: float, intercept: bool = True) -> DataFrame:
    """shifts with what the fit predicts and what is left: ry, rx. Coefficients are 21 rows a data set at most."""
    wide = coefficients.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("term", "coef_y", "coef_x"))).alias("c"))
    terms = poly_terms(F.col("det_y") - u0, F.col("det_x") - v0, order, intercept)
    predicted = lambda name: sum((F.get("c", k)[name] * t for k, t in enumerate(terms)), F.lit(0.0))
    out = shifts.join(wide, "dataset_id").withColumns({"fit_y": predicted("coef_y"), "fit_x": predicted("coef_x")})
    return out.withColumns({"ry": F.col("shift_y") - F.col("fit_y"), "rx": F.col("shift_x") - F.col("fit_x")}).drop("c")


# --- reconstruction --------------------------------------------------------------------------------------------------


def join_shift_map(images: DataFrame, shifts: DataFrame, threshold: float) -> DataFrame:
    """Images of the detector pixels whose quality is above a threshold, with their shifts. Shifts are one small row each."""
    good = shifts.where(F.col("quality") > threshold).select(*_AT, "shift_y", "shift_x", "quality")
    return images.select(*_AT, "scan_h", "scan_w", "img").join(good, _AT)


#: Pixels of an output image that are sent as one row. A group adds up one block of each task, 12 KB, and tasks that
#: have rows of a data set are at most as many as its detector pixels.
PIXELS = 1024
_SUMS = "dataset_id string, block int, w int, size int, total binary, n binary"


class _Sums:
    """Sums and counts of output images, one a data set; a task sends each on once, in blocks of PIXELS."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, id_: str, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        return self.held.setdefault(id_, (np.zeros((h, w)), np.zeros((h, w), np.int32)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for id_, (total, count) in self.held.items():
            n, flat, hits = total.shape[1], total.ravel(), count.ravel()
            rows = []
            for lo in range(0, len(flat), PIXELS):
                here = hits[lo : lo + PIXELS]
                some = here.any()
                rows.append((id_, lo // PIXELS, n, len(here), flat[lo : lo + PIXELS].tobytes() if some else None, here.tobytes() if some else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dataset_id", "block", "w", "size", "total", "n"])


def _add_task(mean: bool) -> Callable:
    def task(table: pa.Table) -> pa.Table:
        size, w, block = (table.column(c)[0].as_py() for c in ("size", "w", "block"))
        total, count = np.zeros(size), np.zeros(size, np.int64)
        for t, n in zip(table.column("total").to_pylist(), table.column("n").to_pylist(), strict=True):
            if n is not None:
                total += np.frombuffer(t)
                count += np.frombuffer(n, np.int32)
        if mean:
            total = np.divide(total, count, out=np.zeros(size), where=count > 0)
        y, x = np.divmod(np.arange(size) + block * PIXELS, w)
        ids = pa.array([table.column("dataset_id")[0].as_py()] * size, pa.string())
        return pa.table({"dataset_id": ids, "y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32)), "value": pa.array(total), "n": pa.array(count)})

    return task


def _added(sums: DataFrame, mean: bool) -> DataFrame:
    """dataset_id, y, x, value, n from the blocks of all tasks: sums, or means that are 0 where nothing was added."""
    return sums.groupBy("dataset_id", "block").applyInArrow(_add_task(mean), "dataset_id string, y int, x int, value double, n long")


def _last(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of an axis, and the last sample on each."""
    places, back = np.unique(at[::-1], return_index=True)
    return places, len(at) - 1 - back


def _strides(to: np.ndarray, from_: np.ndarray, step: int) -> list[tuple[slice, slice]] | None:
    """Places and samples as slices: a shift moves all samples alike, so places are `step` apart but for those that the
    border clips. None where they are not (halves that are rounded to either side)."""
    cut = np.flatnonzero((np.diff(to) != step) | (np.diff(from_) != 1)) + 1
    if len(cut) > 4:
        return None
    ends = zip([0, *cut.tolist()], [*cut.tolist(), len(to)], strict=True)
    return [(slice(int(to[a]), int(to[b - 1]) + 1, step), slice(int(from_[a]), int(from_[b - 1]) + 1)) for a, b in ends]


def _place_task(fac: int, pad: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                values = matrices(part.column(5)).reshape(-1, h, w)
                y, x = np.arange(h), np.arange(w)
                big_h, big_w = h * fac + pad, w * fac + pad
                for k, (id_, sy, sx) in enumerate(zip(part.column(0).to_pylist(), part.column(6).to_pylist(), part.column(7).to_pylist(), strict=True)):
                    total, count = sums.of(id_, big_h, big_w)
                    ty = np.clip(np.round((y - (sy - h / 2 - pad / 2 / fac)) * fac), 0, big_h - 1).astype(int)
                    tx = np.clip(np.round((x - (sx - w / 2 - pad / 2 / fac)) * fac), 0, big_w - 1).astype(int)
                    (to_y, from_y), (to_x, from_x) = _last(ty), _last(tx)  # of several samples on one place the last counts
                    rows, columns = _strides(to_y, from_y, fac), _strides(to_x, from_x, fac)
                    if rows and columns:
                        for a, b in rows:
                            for c, d in columns:
                                total[a, c] += values[k, b, d]
                                count[a, c] += 1
                    else:
                        total[np.ix_(to_y, to_x)] += values[k][np.ix_(from_y, from_x)]
                        count[np.ix_(to_y, to_x)] += 1
        yield from sums.rows()

    return task


def reconstruct_superres(images: DataFrame, shifts: DataFrame, fac: int = 4, pad: int = 16, lims: int = 16, threshold: float = 0.8) -> DataFrame:
    """dataset_id, y, x, value, n: shift-and-add onto a grid fac times finer; 0 where no sample falls (n = 0).

    Detector pixels within lims of the middle of those that have shifts, and whose quality is above the threshold take part; of a pixel's samples on
    one place the last counts. Tasks add up their images first, so what is shuffled is one output image a task, in
    blocks of PIXELS."""
    whole = Window.partitionBy("dataset_id")  # one small row a detector pixel
    ends = {"y0": F.min("det_y"), "y9": F.max("det_y"), "x0": F.min("det_x"), "x9": F.max("det_x")}
    near = shifts.select(*_AT, "shift_y", "shift_x", "quality", *(c.over(whole).alias(n) for n, c in ends.items()))
    for at, lo, hi in (("det_y", "y0", "y9"), ("det_x", "x0", "x9")):
        mid = F.expr(f"{lo} + cast(({hi} - {lo} + 1) div 2 as int)")
        near = near.where(F.abs(F.col(at) - mid) <= F.least(F.lit(lims), mid - F.col(lo), F.col(hi) - mid))
    rows = join_shift_map(images, near, threshold).select(*_AT, "scan_h", "scan_w", "img", "shift_y", "shift_x")
    return _added(rows.mapInArrow(_place_task(fac, pad), _SUMS), mean=True)


def contribution_map(reconstructed: DataFrame) -> DataFrame:
    return reconstructed.select("dataset_id", "y", "x", F.col("n").alias("value"))


def _weights(kind: str, t: np.ndarray) -> list[np.ndarray]:
    """Weights of the neighbours 0, 1 (bilinear) or -1 to 2 (bicubic, a = -0.75) of a place t past the first."""
    if kind == "bilinear":
        return [1 - t, t]
    a = -0.75
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def _mirror(k: np.ndarray, n: int) -> np.ndarray:
    """Places beyond an axis mirrored about its end places."""
    if n == 1:
        return np.zeros_like(k)
    m = np.mod(k, 2 * (n - 1))
    return np.where(m < n, m, 2 * (n - 1) - m)


def _axis(kind: str, n: int, up: int, shift: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which output places of an axis lie inside the image, and source places with weights."""
    at = np.linspace(0, n - 1, n * up) - shift
    inside = (at >= 0) & (at <= n - 1)
    if kind == "nearest":
        k = np.rint(at).astype(int)
        inside = (k >= 0) & (k <= n - 1)
        return inside, [(np.clip(k, 0, n - 1), np.ones(len(k)))]
    first = np.floor(at).astype(int)
    if kind == "bilinear":
        return inside, [(np.clip(first + j, 0, n - 1), w) for j, w in enumerate(_weights(kind, at - first))]
    return np.ones(len(at), bool), [(_mirror(first + j - 1, n), w) for j, w in enumerate(_weights(kind, at - first))]


def _align_task(kind: str, up: int, sign: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                values = matrices(part.column(5)).astype(float).reshape(-1, h, w)
                for k, (id_, sy, sx) in enumerate(zip(part.column(0).to_pylist(), part.column(6).to_pylist(), part.column(7).to_pylist(), strict=True)):
                    total, count = sums.of(id_, h * up, w * up)
                    in_y, rows = _axis(kind, h, up, sign * sy)
                    in_x, columns = _axis(kind, w, up, sign * sx)
                    rowwise = sum(wy[:, None] * values[k][y] for y, wy in rows)
                    out = sum(wx[None, :] * rowwise[:, x] for x, wx in columns) * (in_y[:, None] & in_x[None, :])
                    total += out
                    count += out != 0 if kind == "nearest" else in_y[:, None] & in_x[None, :]
        yield from sums.rows()

    return task


def align(images: DataFrame, shifts: DataFrame, kind: str = "bilinear", upscale: int = 1, reduce: str = "mean", sign: int = 1) -> DataFrame:
    """Images sampled at the output grid minus their shift (times sign), added up or averaged: dataset_id, y, x, value, n.

    kind: bilinear (0 outside; the mean is over samples inside), nearest (0 outside; over samples that aren't 0) or
    bicubic (mirrored edges; over all). Tasks add up their images first."""
    if kind not in ("bilinear", "nearest", "bicubic") or reduce not in ("mean", "sum"):
        raise ValueError("kind is bilinear, nearest or bicubic, reduce is mean or sum")
    rows = images.select(*_AT, "scan_h", "scan_w", "img").join(shifts.select(*_AT, "shift_y", "shift_x"), _AT)
    sums = rows.select(*_AT, "scan_h", "scan_w", "img", "shift_y", "shift_x").mapInArrow(_align_task(kind, upscale, sign), _SUMS)
    return _added(sums, mean=reduce == "mean")


def interpolation_neighbours(image: DataFrame, shift_y: float, shift_x: float) -> DataFrame:
    """An image (dataset_id, y, x, value) sampled bilinearly at its own places minus one shift; places outside have no row.

    Each place looks up its four neighbours by an equal join on whole coordinates."""
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("o")
    fy, fx = F.col("y") - shift_y, F.col("x") - shift_x
    wanted = image.select("dataset_id", "y", "x", F.floor(fy).cast("int").alias("y0"), F.floor(fx).cast("int").alias("x0"), (fy - F.floor(fy)).alias("ty"), (fx - F.floor(fx)).alias("tx"), corners)
    weight = F.when(F.col("o.a") == 1, F.col("ty")).otherwise(1 - F.col("ty")) * F.when(F.col("o.b") == 1, F.col("tx")).otherwise(1 - F.col("tx"))
    wanted = wanted.select("dataset_id", "y", "x", (F.col("y0") + F.col("o.a")).alias("py"), (F.col("x0") + F.col("o.b")).alias("px"), weight.alias("w")).where("w <> 0")
    pixels = image.select("dataset_id", F.col("y").alias("py"), F.col("x").alias("px"), "value")
    found = wanted.join(pixels, ["dataset_id", "py", "px"], "left").groupBy("dataset_id", "y", "x")
    return found.agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.bool_and(F.col("value").isNotNull()).alias("inside")).where("inside").drop("inside")


def top_detector_pixels(shifts: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k detector pixels of greatest quality, with whether they are above the threshold."""
    return shifts.orderBy(F.desc("quality"), "dataset_id", "det_y", "det_x").limit(k).select(*_AT, "quality", (F.col("quality") > threshold).alias("used"))


def pixel_usage(shifts: DataFrame, threshold: float) -> DataFrame:
    return shifts.groupBy("dataset_id").agg(F.count_if(F.col("quality") > threshold).alias("used"), F.count_if(~(F.col("quality") > threshold)).alias("skipped"), F.max("quality").alias("best"))


def opposing_pixels(mask: DataFrame, cy: int, cx: int) -> DataFrame:
    """Pixels of a mask with their mirror images about the centre, each pair once."""
    other = mask.select(F.col("det_y").alias("opp_y"), F.col("det_x").alias("opp_x"))
    pairs = mask.join(other, (F.col("opp_y") == 2 * cy - F.col("det_y")) & (F.col("opp_x") == 2 * cx - F.col("det_x")))
    return pairs.where((F.col("det_y") < F.col("opp_y")) | (F.col("det_y") == F.col("opp_y")) & (F.col("det_x") < F.col("opp_x")))


def last_write_per_target(writes: DataFrame, target: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Of all values written to one target the last: the one of the greatest order (columns compared in turn), and how many
    there were. The greatest so far is kept inside each task, so a target may have any number of writes; of equal orders
    the greatest value stays, whatever the order of the rows."""
    at = F.struct(*order, value)
    last = writes.groupBy(*target).agg(F.max(at).alias("_last"), F.count(F.lit(1)).alias("n"))
    return last.select(*target, F.col(f"_last.{value}").alias(value), "n")
