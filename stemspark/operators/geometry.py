"""Where the bright-field disk lies, and profiles over the radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import explode_voxels


def bf_center_com(frames: DataFrame, fraction: float = 0.1, scan_y: int = 0, scan_x: int = 0) -> DataFrame:
    """Centroid of one frame's pixels above a fraction of its greatest; the detector's centre if there are none."""
    frame = frames.where((F.col("scan_y") == scan_y) & (F.col("scan_x") == scan_x)).withColumn("t", fraction * F.array_max("counts"))
    rows = frame.select("dataset_id", "det_h", "det_w", "t", F.posexplode("counts").alias("pos", "c"))
    use = F.when(F.col("c") > F.col("t"), F.col("c").cast("double"))
    y, x = F.expr("pos div det_w"), F.col("pos") % F.col("det_w")
    out = rows.groupBy("dataset_id", "det_h", "det_w").agg(F.sum(use).alias("n"), F.sum(use * y).alias("sy"), F.sum(use * x).alias("sx"))
    n = F.nullif("n", F.lit(0.0))
    return out.select("dataset_id", F.coalesce(F.col("sy") / n, F.expr("cast(det_h div 2 as double)")).alias("cy"), F.coalesce(F.col("sx") / n, F.expr("cast(det_w div 2 as double)")).alias("cx"))


def bf_disk_bounds(patterns: DataFrame, fraction: float = 0.5, padding: int = 2) -> DataFrame:
    """A square crop about the disk of a pattern (dataset_id, det_y, det_x, value): y1, y2, x1, x2, cy, cx.

    Pixels above min + fraction (max - min) count; a data set in which none is above has no row."""
    low = patterns.groupBy("dataset_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("det_y") + 1).alias("h"), (F.max("det_x") + 1).alias("w"))
    rows = patterns.join(low, "dataset_id").where(F.col("value") > F.col("lo") + fraction * (F.col("hi") - F.col("lo")))
    v = F.col("value").cast("double")
    out = rows.groupBy("dataset_id", "h", "w").agg(
        F.floor(F.sum(v * F.col("det_y")) / F.sum(v)).cast("int").alias("cy"),
        F.floor(F.sum(v * F.col("det_x")) / F.sum(v)).cast("int").alias("cx"),
        F.greatest(F.max("det_y") - F.min("det_y"), F.max("det_x") - F.min("det_x")).alias("extent"),
    )
    half = F.floor((F.col("extent") + 2 * padding) / 2).cast("int")

    def clipped(c, n, r):
        return F.greatest(F.lit(0), c - r), F.least(n, c + r)

    y1, y2 = clipped(F.col("cy"), F.col("h"), half)
    x1, x2 = clipped(F.col("cx"), F.col("w"), half)
    out = out.withColumns({"y1": y1, "y2": y2, "x1": x1, "x2": x2})
    mid = {"my": F.expr("cast((y1 + y2) div 2 as int)"), "mx": F.expr("cast((x1 + x2) div 2 as int)"), "r": F.expr("cast(least(y2 - y1, x2 - x1) div 2 as int)")}
    out = out.withColumns(mid)
    y1, y2 = clipped(F.col("my"), F.col("h"), F.col("r"))
    x1, x2 = clipped(F.col("mx"), F.col("w"), F.col("r"))
    return out.select("dataset_id", y1.alias("y1"), y2.alias("y2"), x1.alias("x1"), x2.alias("x2"), "cy", "cx")


def radial_profile(patterns: DataFrame, cy: float, cx: float, max_r: int = 100) -> DataFrame:
    """Mean of a pattern (dataset_id, det_y, det_x, value) for each whole radius; beyond max_r all is one bin."""
    r = F.floor(F.sqrt(F.pow(F.col("det_x") - cx, F.lit(2)) + F.pow(F.col("det_y") - cy, F.lit(2)))).cast("int")
    return patterns.groupBy("dataset_id", F.least(r, F.lit(max_r)).alias("r")).agg(F.avg("value").alias("value"))


def radial_frequency_profile(spectrum: DataFrame, n: int) -> DataFrame:
    """Mean magnitude (dataset_id, ky, kx, value; unshifted, n x n) for each radius below n / 2; 0 where there is none."""
    y, x = F.pmod(F.col("ky") + n // 2, F.lit(n)) - n // 2, F.pmod(F.col("kx") + n // 2, F.lit(n)) - n // 2
    r = F.floor(F.sqrt((y * y + x * x).cast("double"))).cast("int")
    mean = spectrum.groupBy("dataset_id", r.alias("r")).agg(F.avg("value").alias("value"))
    every = spectrum.select("dataset_id").distinct().select("dataset_id", F.explode(F.sequence(F.lit(0), F.lit(max(1, n // 2) - 1))).alias("r"))
    return every.join(mean, ["dataset_id", "r"], "left").select("dataset_id", "r", F.coalesce("value", F.lit(0.0)).alias("value"))


def radial_gradient(profile: DataFrame) -> DataFrame:
    """Central differences of a profile (dataset_id, r, value), one-sided at its ends. A profile has max_r rows at most."""
    w = Window.partitionBy("dataset_id").orderBy("r")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    inner = (after - before) / 2
    return profile.select("dataset_id", "r", F.coalesce(inner, after - F.col("value"), F.col("value") - before, F.lit(0.0)).alias("gradient"))


def bf_radius(profile: DataFrame) -> DataFrame:
    """The first radius at which the gradient is steepest; the last bin of the profile is left out."""
    w = Window.partitionBy("dataset_id")
    rows = profile.withColumn("last", F.max("r").over(w)).where("r < last").drop("last")
    steep = radial_gradient(rows).groupBy("dataset_id").agg(F.max_by("r", F.struct(F.abs("gradient"), -F.col("r"))).alias("radius"))
    return steep


def pattern_of(frames: DataFrame, scan_y: int = 0, scan_x: int = 0) -> DataFrame:
    """One frame as a pattern: dataset_id, det_y, det_x, value."""
    one = explode_voxels(frames.where((F.col("scan_y") == scan_y) & (F.col("scan_x") == scan_x)))
    return one.select("dataset_id", "det_y", "det_x", F.col("count").alias("value"))
