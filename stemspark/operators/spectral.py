"""Fourier transforms over the scan axes. A scan image must fit in a task: 4096 x 4096 doubles take 128 MB."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import complex_abs, complex_mul_conj, complex_phase
from .dense import by_shape, matrices, scattered, summed
from .select import sample_positions

SPECTRA = "dataset_id string, det_y int, det_x int, scan_h int, scan_w int, re array<double>, im array<double>"


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _fft_task(inverse: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, w in by_shape(batch, 3, 4):
                values = matrices(part.column(5)).astype(complex)
                if inverse:
                    values = values + 1j * matrices(part.column(6))
                out = (np.fft.ifft2 if inverse else np.fft.fft2)(values.reshape(-1, h, w)).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], lists(out.real), lists(out.imag)], names=["dataset_id", "det_y", "det_x", "scan_h", "scan_w", "re", "im"])

    return task


def fft_scan(images: DataFrame) -> DataFrame:
    """Transform of every detector pixel's image (layout.pixel_images), unshifted; batch by batch, nothing is shuffled."""
    return images.select("dataset_id", "det_y", "det_x", "scan_h", "scan_w", "img").mapInArrow(_fft_task(False), SPECTRA)


def ifft_scan(spectra: DataFrame) -> DataFrame:
    """Inverse of fft_scan, with its real part as img."""
    rows = spectra.select("dataset_id", "det_y", "det_x", "scan_h", "scan_w", "re", "im")
    return rows.mapInArrow(_fft_task(True), SPECTRA).withColumnRenamed("re", "img").drop("im")


def frequencies(spectra: DataFrame) -> DataFrame:
    """One row per detector pixel and frequency: ky, kx, re, im."""
    out = spectra.select("dataset_id", "det_y", "det_x", "scan_w", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    return out.select("dataset_id", "det_y", "det_x", F.expr("cast(k div scan_w as int)").alias("ky"), (F.col("k") % F.col("scan_w")).cast("int").alias("kx"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def dft_at(frames: DataFrame, ky: int, kx: int, scan_h: int, scan_w: int) -> DataFrame:
    """The pattern at one spatial frequency by a sum over frames, without the whole transform."""

    def weights(values: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[Callable, Callable]:
        angle = 2 * math.pi * (ky * y / scan_h + kx * x / scan_w)  # one a frame
        return (lambda mine: np.cos(angle[mine]) @ values[mine]), (lambda mine: -np.sin(angle[mine]) @ values[mine])

    return summed(frames, weights, np.float64).select("dataset_id", "det_y", "det_x", F.col("a").alias("re"), F.col("b").alias("im"))


def _in_range(column: str, lo: int, hi: int, n: int) -> Column:
    """Whether a frequency lies in lo to hi (excluded), which may wrap around."""
    return F.pmod(F.col(column) - lo, F.lit(n)) < min(hi - lo, n)


def freq_roi_pattern(freqs: DataFrame, ky: tuple[int, int], kx: tuple[int, int], scan_h: int, scan_w: int) -> DataFrame:
    """Amplitude and phase of the mean complex pattern over a region of frequencies, ends excluded, wrapping."""
    some = freqs.where(_in_range("ky", *ky, scan_h) & _in_range("kx", *kx, scan_w))
    mean = some.groupBy("dataset_id", "det_y", "det_x").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    re, im = F.col("re"), F.col("im")
    return mean.select("dataset_id", "det_y", "det_x", complex_abs(re, im).alias("amplitude"), complex_phase(re, im).alias("phase"))


def spatial_freq_map(freqs: DataFrame) -> DataFrame:
    """Mean magnitude over detector pixels for each frequency, and its logarithm."""
    mean = freqs.groupBy("dataset_id", "ky", "kx").agg(F.avg(complex_abs(F.col("re"), F.col("im"))).alias("value"))
    return mean.withColumn("ln", F.log(F.col("value") + 1e-10))


def amplitude_phase(freqs: DataFrame) -> DataFrame:
    re, im = F.col("re"), F.col("im")
    return freqs.withColumns({"amplitude": complex_abs(re, im), "phase": complex_phase(re, im)}).drop("re", "im")


def gather_image(image: DataFrame) -> DataFrame:
    """An image in rows (dataset_id, y, x, value) as one row with img; it must fit in a task. Missing pixels are 0."""
    size = image.groupBy("dataset_id").agg((F.max("y") + 1).alias("scan_h"), (F.max("x") + 1).alias("scan_w"), F.collect_list(F.struct("y", "x", "value")).alias("p"))
    places = F.transform("p", lambda s: s["y"] * F.col("scan_w") + s["x"])
    dense = scattered(size, F.col("scan_h") * F.col("scan_w"), places, F.col("p.value"), "double")
    return dense.select("dataset_id", F.lit(0).alias("det_y"), F.lit(0).alias("det_x"), F.col("scan_h").cast("int").alias("scan_h"), F.col("scan_w").cast("int").alias("scan_w"), F.col("dense").alias("img"))


def image_fft(image: DataFrame) -> DataFrame:
    """Transform of derived images, one a data set: ky, kx shifted so that zero is in the middle, re, im, magnitude, phase."""
    one = gather_image(image)
    size = one.select("dataset_id", F.col("scan_h").alias("h"), F.col("scan_w").alias("w"))
    out = frequencies(fft_scan(one)).join(size, "dataset_id")
    re, im = F.col("re"), F.col("im")
    shift = lambda k, n: F.pmod(F.col(k) + F.floor(F.col(n) / 2).cast("int"), F.col(n)).alias(k)
    return out.select("dataset_id", shift("ky", "h"), shift("kx", "w"), "re", "im", complex_abs(re, im).alias("magnitude"), complex_phase(re, im).alias("phase"))


def _frame_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, h, w in by_shape(batch, 3, 4):
            power = np.abs(np.fft.fft2(matrices(part.column(5)).astype(float).reshape(-1, h, w))).reshape(len(part), -1)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(power.mean(1))], names=["dataset_id", "scan_y", "scan_x", "value"])


def sampled_spectral_map(frames: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Mean magnitude of the detector's transform at n sampled scan positions."""
    some = frames.join(sample_positions(frames, n, seed), ["dataset_id", "scan_y", "scan_x"], "left_semi")
    return some.select("dataset_id", "scan_y", "scan_x", "det_h", "det_w", "counts").mapInArrow(_frame_task, "dataset_id string, scan_y int, scan_x int, value double")


def join_reference_fft(freqs: DataFrame, reference: DataFrame) -> DataFrame:
    """Every pixel's transform times the conjugate of its data set's reference (dataset_id, ky, kx, re, im, one a frequency):
    dataset_id, det_y, det_x, ky, kx, re, im. A frequency meets as many rows as the detector has pixels; how they meet goes by
    the reference's size."""
    ref = reference.select("dataset_id", "ky", "kx", F.col("re").alias("_r"), F.col("im").alias("_i"))
    re, im = complex_mul_conj(F.col("re"), F.col("im"), F.col("_r"), F.col("_i"))
    return freqs.join(ref, ["dataset_id", "ky", "kx"]).select("dataset_id", "det_y", "det_x", "ky", "kx", re.alias("re"), im.alias("im"))
