"""Slices, filters and masks on the four coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.let import let
from ..schemas import SCAN


def diffraction_pattern(frames: DataFrame, y: int, x: int) -> DataFrame:
    """The frame at a scan position, clamped to the scan of each data set."""
    size = frames.groupBy("dataset_id").agg(F.max("scan_y").alias("my"), F.max("scan_x").alias("mx"))
    size = size.select("dataset_id", F.least(F.greatest(F.lit(y), F.lit(0)), "my").alias("scan_y"), F.least(F.greatest(F.lit(x), F.lit(0)), "mx").alias("scan_x"))
    return frames.join(size, SCAN)


def crop_bounds(cy: float, cx: float, radius: int, det_h: int, det_w: int) -> tuple[int, int, int, int]:
    """y1, y2, x1, x2 (ends excluded) of a square about a centre, clipped to the detector."""
    return max(0, int(cy) - radius), min(det_h, int(cy) + radius), max(0, int(cx) - radius), min(det_w, int(cx) + radius)


def crop_detector(frames: DataFrame, y1: int, y2: int, x1: int, x2: int) -> DataFrame:
    """Frames cut to detector rows y1 to y2 and columns x1 to x2 (ends excluded), inside each row: no voxels are made."""
    rows = let("counts", lambda c: F.flatten(F.transform(F.sequence(F.lit(y1), F.lit(y2 - 1)), lambda y: F.slice(c, y * F.col("det_w") + x1 + 1, F.lit(x2 - x1)))))
    return frames.withColumn("counts", rows).withColumns({"det_h": F.lit(y2 - y1), "det_w": F.lit(x2 - x1)})


def crop_voxels(voxels: DataFrame, y1: int, y2: int, x1: int, x2: int) -> DataFrame:
    """The same on voxels: a range that reaches the scan, and coordinates from the crop's corner."""
    kept = voxels.where(F.col("det_y").between(y1, y2 - 1) & F.col("det_x").between(x1, x2 - 1))
    return kept.withColumns({"det_y": F.col("det_y") - y1, "det_x": F.col("det_x") - x1})


def crop_scan(rows: DataFrame, height: int, width: int, scan_h: int, scan_w: int) -> DataFrame:
    """The centred part of the scan, its coordinates from the part's corner."""
    y0, x0 = max(0, (scan_h - height) // 2), max(0, (scan_w - width) // 2)
    kept = rows.where(F.col("scan_y").between(y0, y0 + height - 1) & F.col("scan_x").between(x0, x0 + width - 1))
    return kept.withColumns({"scan_y": F.col("scan_y") - y0, "scan_x": F.col("scan_x") - x0})


def unscramble_eels(frames: DataFrame) -> DataFrame:
    """Rectangular frames with the energy axis last: pixels keep their flat order, only the extents swap."""
    tall = F.col("det_h") > F.col("det_w")
    return frames.withColumns({"det_h": F.when(tall, F.col("det_w")).otherwise(F.col("det_h")), "det_w": F.when(tall, F.col("det_h")).otherwise(F.col("det_w"))})


def flip_energy(frames: DataFrame) -> DataFrame:
    """Frames with every detector row reversed."""
    rows = let("counts", lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.col("det_h") - 1), lambda y: F.reverse(F.slice(c, y * F.col("det_w") + 1, F.col("det_w"))))))
    return frames.withColumn("counts", rows)


def roi_rectangle(rows: DataFrame, y: int, x: int, h: int, w: int, scan_h: int, scan_w: int) -> DataFrame:
    """Scan positions in a rectangle, clamped so that at least one is left."""
    y1, x1 = min(max(y, 0), scan_h - 1), min(max(x, 0), scan_w - 1)
    y2, x2 = min(max(y + h, y1 + 1), scan_h), min(max(x + w, x1 + 1), scan_w)
    return rows.where(F.col("scan_y").between(y1, y2 - 1) & F.col("scan_x").between(x1, x2 - 1))


def roi_rotated(rows: DataFrame, cy: float, cx: float, h: float, w: float, degrees: float) -> DataFrame:
    """Scan positions whose coordinates in the rectangle's own axes lie in it, edges included."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dy, dx = F.col("scan_y") - cy, F.col("scan_x") - cx
    return rows.where((F.abs(dx * c + dy * s) <= w / 2) & (F.abs(dy * c - dx * s) <= h / 2))


def roi_point(rows: DataFrame, y: int, x: int) -> DataFrame:
    return rows.where((F.col("scan_y") == y) & (F.col("scan_x") == x))


def line_profile(voxels: DataFrame, det_y: int) -> DataFrame:
    """One detector row of every scan position."""
    return voxels.where(F.col("det_y") == det_y).select("dataset_id", "scan_y", "scan_x", F.col("det_x").alias("channel"), F.col("count").alias("value"))


def threshold_frame(frames: DataFrame, fraction: float) -> DataFrame:
    """Frames whose pixels at or below a fraction of their greatest are 0."""
    cut = let("counts", lambda a: let(fraction * F.array_max(a), lambda t: F.transform(a, lambda c: F.when(c > t, c).otherwise(F.lit(0)))))
    return frames.withColumn("counts", cut)


def threshold_mask(frames: DataFrame, fraction: float) -> DataFrame:
    """1 where a pixel is above min + fraction (max - min) of its frame, else 0."""
    level = lambda a: F.array_min(a) + fraction * (F.array_max(a) - F.array_min(a))
    return frames.withColumn("counts", let("counts", lambda a: let(level(a), lambda t: F.transform(a, lambda c: (c > t).cast("int")))))


def in_disk(y: Column, x: Column, cy, cx, r) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def in_annulus(y: Column, x: Column, cy, cx, inner, outer) -> Column:
    d = (x - cx) * (x - cx) + (y - cy) * (y - cy)
    return (d >= inner * inner) & (d <= outer * outer)


def _grid(spark: SparkSession, h: int, w: int) -> DataFrame:
    return spark.range(h * w).select(F.expr(f"cast(id div {w} as int)").alias("det_y"), (F.col("id") % w).cast("int").alias("det_x"))


def disk_mask(spark: SparkSession, h: int, w: int, cy: float, cx: float, r: float) -> DataFrame:
    """det_y, det_x of a disk's pixels; at most h x w rows."""
    return _grid(spark, h, w).where(in_disk(F.col("det_y"), F.col("det_x"), F.lit(cy), F.lit(cx), F.lit(r)))


def annulus_mask(spark: SparkSession, h: int, w: int, cy: float, cx: float, inner: float, outer: float) -> DataFrame:
    """det_y, det_x of an annulus, both edges included."""
    return _grid(spark, h, w).where(in_annulus(F.col("det_y"), F.col("det_x"), F.lit(cy), F.lit(cx), F.lit(inner), F.lit(outer)))


def fftshift(k: Column, n: Column | int) -> Column:
    """Where frequency k stands once the zero is in the middle."""
    return F.pmod(k + F.floor((F.lit(n) if isinstance(n, int) else n) / 2).cast("int"), F.lit(n) if isinstance(n, int) else n)


def display_to_stored(p: Column, n: int) -> Column:
    """The stored frequency that a display place shows."""
    return F.pmod(p - n // 2, F.lit(n))


def sample_positions(frames: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n scan positions that a seeded hash (MD5 of seed and position) picks: the same whatever the partitions are."""
    return frames.select(*SCAN).orderBy(F.md5(F.concat_ws(",", F.lit(seed), *SCAN).cast("binary")), *SCAN).limit(n)


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    return frames.where(F.col("frame_idx") < n)


def pixel_difference(frames: DataFrame, a: tuple[int, int], b: tuple[int, int], weight_a: float = 1, weight_b: float = -1) -> DataFrame:
    """A weighted sum of two detector pixels' scan images; their difference by default."""
    at = lambda p: F.get("counts", p[0] * F.col("det_w") + p[1])
    return frames.select(*SCAN, (weight_a * at(a) + weight_b * at(b)).alias("value"))


def distinct_positions(rows: DataFrame, n: int) -> DataFrame:
    """The first n distinct scan positions, in scan order."""
    return rows.select(*SCAN).distinct().orderBy(*SCAN).limit(n)
