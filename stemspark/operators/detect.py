"""Virtual detectors, spectra, and the processing of cubes: sums over the detector inside each row of frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..schemas import SCAN
from .dense import masked_sum, run_lengths, summed, totals, weighted_runs
from .select import flip_energy, in_annulus, in_disk


def _total(counts: Column | str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)


def scan_overview(frames: DataFrame) -> DataFrame:
    """Sum over the detector, for each scan position."""
    return frames.select(*SCAN, _total("counts").alias("value"))


def virtual_bf(frames: DataFrame, cy: float, cx: float, radius: float) -> DataFrame:
    """Sum inside a disk, for each scan position; batch by batch, nothing is shuffled."""
    return masked_sum(frames, lambda y, x, h, w: in_disk(y, x, cy, cx, radius))


def virtual_df(frames: DataFrame, cy: float, cx: float, inner: float, outer: float) -> DataFrame:
    """Sum inside an annulus, for each scan position."""
    return masked_sum(frames, lambda y, x, h, w: in_annulus(y, x, cy, cx, inner, outer))


def mean_bf(frames: DataFrame) -> DataFrame:
    return frames.select(*SCAN, (_total("counts") / F.size("counts")).alias("value"))


def apply_mask(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Sums of voxels under a mask (det_y, det_x, and w for weights), for each scan position.

    A mask has at most a row for each detector pixel; beyond spark.sql.autoBroadcastJoinThreshold it is shuffled."""
    if "w" not in mask.columns:
        return voxels.join(mask, ["det_y", "det_x"], "left_semi").groupBy(*SCAN).agg(F.sum("count").alias("value"))
    return voxels.join(mask, ["det_y", "det_x"]).groupBy(*SCAN).agg(F.sum(F.col("count") * F.col("w")).alias("value"))


def mask_frames(frames: DataFrame, mask: DataFrame) -> DataFrame:
    """apply_mask on frames, a row a frame: the mask (det_y, det_x, and w for weights) goes to the tasks as runs of pixels, at
    most one a detector pixel, and is summed inside Arrow batches; no voxel is made and nothing is shuffled."""
    whole = "w" not in mask.columns or dict(mask.dtypes)["w"] in ("tinyint", "smallint", "int", "bigint")
    pixels = mask.select("det_y", "det_x", *(["w"] if "w" in mask.columns else [])).dropna()
    rows = [(r[0], r[1], r[2] if "w" in mask.columns else 1) for r in (pixels if "w" in mask.columns else pixels.distinct()).collect()]  # a detector's pixels
    return weighted_runs(frames, run_lengths(rows), whole)


def energy_window_image(frames: DataFrame, e0: int = 10, e1: int = 200) -> DataFrame:
    """Sum over all detector rows and the channels e0 to e1 (excluded), clamped to the detector."""
    return masked_sum(frames, lambda y, x, h, w: (x >= max(e0, 0)) & (x < min(e1, w)))


def roi_spectrum(frames: DataFrame) -> DataFrame:
    """Mean over the frames and the shorter detector axis, for each channel of the longer one. Frames are added up inside tasks."""
    rows = summed(frames, totals).join(frames.select("dataset_id", "det_h", "det_w").distinct(), "dataset_id")
    channel = F.when(F.col("det_w") >= F.col("det_h"), F.col("det_x")).otherwise(F.col("det_y"))
    return rows.groupBy("dataset_id", channel.alias("channel")).agg((F.sum("a") / F.sum("n")).alias("value"))


def sum_pattern(frames: DataFrame) -> DataFrame:
    """Sum and mean over the scan of each detector pixel. Frames are added up inside tasks."""
    return summed(frames, totals).select("dataset_id", "det_y", "det_x", F.col("a").alias("total"), (F.col("a") / F.col("n")).alias("mean"))


def bin_detector(frames: DataFrame, factor: int, method: str = "mean") -> DataFrame:
    """Frames binned factor x factor, by mean or sum; an error where factor doesn't divide the detector.

    Each frame is binned inside its row."""
    if method not in ("mean", "sum"):
        raise ValueError("method is mean or sum")
    even = (F.col("det_h") % factor == 0) & (F.col("det_w") % factor == 0)
    height, width = F.expr(f"det_h div {factor}").cast("int"), F.expr(f"det_w div {factor}").cast("int")
    square = [(dy, dx) for dy in range(factor) for dx in range(factor)]

    def bin_(a: Column, k: Column) -> Column:
        y, x = F.floor(k / F.col("w")).cast("int") * factor, (k % F.col("w")).cast("int") * factor
        total = sum((F.get(a, (y + dy) * F.col("det_w") + x + dx).cast("long") for dy, dx in square), F.lit(0).cast("long"))
        return total / (factor * factor) if method == "mean" else total

    checked = frames.withColumn("counts", F.when(even, F.col("counts")).otherwise(F.raise_error(F.lit(f"bin factor {factor} does not divide the detector"))))
    sized = checked.withColumns({"h": height, "w": width})
    binned = let("counts", lambda a: F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda k: bin_(a, k)))
    return sized.withColumn("counts", binned).withColumns({"det_h": F.col("h"), "det_w": F.col("w")}).drop("h", "w")


def sum_y(frames: DataFrame) -> DataFrame:
    """Frames summed over their rows: one row of det_w channels."""
    def at(counts: Column, x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.col("det_h") - 1), F.lit(0).cast("long"), lambda a, y: a + F.get(counts, (y * F.col("det_w") + x).cast("int")))

    total = let("counts", lambda c: F.transform(F.sequence(F.lit(0), F.col("det_w") - 1), lambda x: at(c, x)))
    return frames.withColumn("counts", total).withColumn("det_h", F.lit(1))


def process_cube(frames: DataFrame, bin_factor: int = 1, bin_method: str = "mean", sum_rows: bool = False, flip: bool = False) -> DataFrame:
    """Binning, then the sum over rows, then the flip of the energy axis."""
    out = bin_detector(frames, bin_factor, bin_method) if bin_factor > 1 else frames
    out = sum_y(out) if sum_rows else out
    return flip_energy(out) if flip else out


def detector_energy(frames: DataFrame, reference_energy: float = 1.0) -> DataFrame:
    """Sum of squares of each detector pixel's image times the reference's; less than 1e-9 counts as 1."""
    total = summed(frames, totals, np.float64)
    norm = F.col("b") * reference_energy
    return total.select("dataset_id", "det_y", "det_x", F.when(norm < 1e-9, F.lit(1.0)).otherwise(norm).alias("norm"))


def join_context_image(image: DataFrame, context: DataFrame) -> DataFrame:
    """A scan image with the context image of its data set (dataset_id, scan_y, scan_x, value) at the same positions.

    A context image of another extent than the scan is refused: the job ends with an error that names the data set."""
    size = lambda df, n: df.groupBy("dataset_id").agg(F.struct((F.max("scan_y") + 1).alias("h"), (F.max("scan_x") + 1).alias("w")).alias(n))
    both = size(image, "_scan").join(size(context, "_context"), "dataset_id")
    told = F.concat(F.lit("context image of "), "dataset_id", F.lit(": "), F.to_json("_context"), F.lit(" is no scan of "), F.to_json("_scan"))
    fits = both.select("dataset_id", F.when(F.col("_scan") == F.col("_context"), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")).alias("_fits"))
    return image.join(context, ["dataset_id", "scan_y", "scan_x"]).join(fits, "dataset_id").where("_fits").drop("_fits")
