"""Statistics of cubes and images, comparisons of cubes, checks of data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AT = ["dataset_id", "scan_y", "scan_x", "det_y", "det_x"]


def histogram(rows: DataFrame, value: str = "value", bins: int = 100) -> DataFrame:
    """Counts of values in equal bins from least to greatest, which falls in the last; the range is a broadcast row."""
    span = F.broadcast(rows.groupBy("dataset_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.width_bucket(F.col(value).cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double"), F.lit(bins)), F.lit(bins)))
    return rows.join(span, "dataset_id").groupBy("dataset_id", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def value_distribution(voxels: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct values, zeros and values up to 50, with shares. exact=False estimates the distinct ones in small state."""
    distinct = F.count_distinct("count") if exact else F.approx_count_distinct("count")
    n, zero, low = F.count(F.lit(1)), F.count_if(F.col("count") == 0), F.count_if(F.col("count") <= 50)
    return voxels.groupBy("dataset_id").agg(distinct.alias("n_values"), n.alias("n"), zero.alias("zeros"), low.alias("low"), F.round(zero / n, 6).alias("zero_share"), F.round(low / n, 6).alias("low_share"))


def sparsity(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("dataset_id").agg(F.avg((F.col("count") == 0).cast("int")).alias("sparsity"))


def quality_stats(shifts: DataFrame, exact: bool = True) -> DataFrame:
    """Ranges of shifts, and mean, median and range of quality."""
    median = F.percentile("quality", 0.5) if exact else F.percentile_approx("quality", 0.5)
    return shifts.groupBy("dataset_id").agg(
        F.min("shift_y").alias("min_y"), F.max("shift_y").alias("max_y"), F.min("shift_x").alias("min_x"), F.max("shift_x").alias("max_x"), F.avg("quality").alias("mean_q"), median.alias("median_q"), F.min("quality").alias("min_q"), F.max("quality").alias("max_q")
    )


def dataset_stats(voxels: DataFrame, value: str = "count") -> DataFrame:
    """Least, greatest, mean, and standard deviation of the population."""
    return voxels.groupBy("dataset_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def compare_cubes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Voxels of two cubes side by side; a side that is missing is 0 and flagged."""
    x, y = a.select(*_AT, F.col("count").alias("a")), b.select(*_AT, F.col("count").alias("b"))
    out = x.join(y, _AT, "full")
    zero = F.lit(0)
    return out.select(*_AT, F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"), F.col("a").isNull().alias("missing_a"), F.col("b").isNull().alias("missing_b"))


def compare_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """compare_cubes of two cubes of frames: frames meet by scan position, and their pixels side by side without a shuffle of
    voxels."""
    at = ["dataset_id", "scan_y", "scan_x"]
    x, y = a.select(*at, F.col("det_w").alias("wa"), F.col("counts").alias("a")), b.select(*at, F.col("det_w").alias("wb"), F.col("counts").alias("b"))
    both = x.join(y, at, "full").select(*at, F.coalesce("wa", "wb").alias("w"), F.posexplode(F.arrays_zip(F.coalesce("a", F.array().cast("array<int>")).alias("a"), F.coalesce("b", F.array().cast("array<int>")).alias("b"))).alias("pos", "v"))
    zero = F.lit(0)
    return both.select(*at, F.expr("cast(pos div w as int)").alias("det_y"), (F.col("pos") % F.col("w")).cast("int").alias("det_x"), F.coalesce("v.a", zero).alias("a"), F.coalesce("v.b", zero).alias("b"), F.col("v.a").isNull().alias("missing_a"), F.col("v.b").isNull().alias("missing_b"))


def cube_diff_stats(compared: DataFrame) -> DataFrame:
    """Of compare_cubes(): range, mean and deviation of a - b, share that differs, voxels that only one side has as 0."""
    d = (F.col("a") - F.col("b")).cast("long")
    return compared.groupBy("dataset_id").agg(
        F.min(d).alias("lo"), F.max(d).alias("hi"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), (100 * F.avg((d != 0).cast("int"))).alias("percent_differing"), F.count_if((F.col("b") == 0) & (F.col("a") != 0)).alias("zeroed_in_b"), F.count_if((F.col("a") == 0) & (F.col("b") != 0)).alias("zeroed_in_a")
    )


def corruption_by_radius(compared: DataFrame, det_h: int, det_w: int) -> DataFrame:
    """Detector pixels with a difference that lie farther from the centre than n/8, n/4 and n/2, n the shorter side."""
    pixel = compared.groupBy("dataset_id", "det_y", "det_x").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("d")).where("d > 0")
    n = min(det_h, det_w)
    radii = F.explode(F.array(*(F.lit(n // k) for k in (8, 4, 2)))).alias("radius")
    rows = pixel.select("dataset_id", "det_y", "det_x", radii)
    far = F.pow(F.col("det_y") - det_h // 2, F.lit(2)) + F.pow(F.col("det_x") - det_w // 2, F.lit(2)) > F.col("radius") * F.col("radius")
    return rows.groupBy("dataset_id", "radius").agg(F.count_if(far).alias("outside"), F.count(F.lit(1)).alias("differing"))


def sampled_match_rate(positions: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Percentage of sampled voxels that are equal in two cubes of frames. positions has as many rows as were asked for.

    Frames are narrowed to the sampled scan positions, and of each its pixel is taken; no cube is exploded."""
    at, scan = positions.select(*_AT), ["dataset_id", "scan_y", "scan_x"]
    wanted = at.select(*scan).distinct()
    side = lambda t, n: t.select(*scan, F.col("det_w").alias(f"w{n}"), F.col("counts").alias(f"c{n}")).join(wanted, scan, "left_semi")
    pixel = lambda n: F.when(F.col("det_x") < F.col(f"w{n}"), F.get(f"c{n}", F.col("det_y") * F.col(f"w{n}") + F.col("det_x"))).alias(n)
    both = at.join(side(a, "a"), scan, "left").join(side(b, "b"), scan, "left").select(*_AT, pixel("a"), pixel("b"))
    return both.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int"))).alias("percent_equal"))


def all_zero_check(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.groupBy("dataset_id").agg((~F.bool_or(F.col(value) != 0)).alias("all_zero"))


def residual_stats(residuals: DataFrame) -> DataFrame:
    """Of residuals (dataset_id, ry, rx): RMSE over components and over vectors, mean, greatest and deviation of lengths."""
    sq, m = F.col("ry") * F.col("ry") + F.col("rx") * F.col("rx"), F.hypot("ry", "rx")
    return residuals.groupBy("dataset_id").agg(F.sqrt(F.avg(sq) / 2).alias("rmse_component"), F.sqrt(F.avg(sq)).alias("rmse_vector"), F.avg(m).alias("mean"), F.max(m).alias("greatest"), F.stddev_pop(m).alias("sd"))


def contrast_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """Deviation of image a over that of image b, and their RMSE where both have a pixel. Images: dataset_id, y, x, value."""
    sd = lambda t, n: t.groupBy("dataset_id").agg(F.stddev_pop("value").alias(n))
    both = a.select("dataset_id", "y", "x", F.col("value").alias("va")).join(b.select("dataset_id", "y", "x", F.col("value").alias("vb")), ["dataset_id", "y", "x"])
    rmse = both.groupBy("dataset_id").agg(F.sqrt(F.avg((F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb")))).alias("rmse"))
    return sd(a, "sa").join(sd(b, "sb"), "dataset_id").join(rmse, "dataset_id").select("dataset_id", F.try_divide("sa", "sb").alias("ratio"), "rmse")


def throughput_stats(log: DataFrame) -> DataFrame:
    """Of a conversion log (dataset_id, stage, in_bytes, out_bytes, seconds): totals and MB/s of each stage."""
    return log.groupBy("dataset_id", "stage").agg(F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), F.sum("seconds").alias("seconds"), F.try_divide(F.sum("in_bytes") / 1e6, F.sum("seconds")).alias("mb_per_s"), F.try_divide(F.sum("in_bytes"), F.sum("out_bytes")).alias("ratio"))


def rank_layouts(sizes: DataFrame) -> DataFrame:
    """Layouts (codec, layout, size_bytes, raw_bytes) by how far they shrink, best first."""
    return sizes.withColumn("ratio", F.try_divide("raw_bytes", "size_bytes")).orderBy(F.desc("ratio"), "codec", "layout")


def shape_check(voxels: DataFrame, datasets: DataFrame) -> DataFrame:
    """Extents found against those of the catalog (scan_h, scan_w, det_h, det_w), and whether it is a spectrum image."""
    found = voxels.groupBy("dataset_id").agg(*((F.max(c) + 1).alias(n) for c, n in (("scan_y", "sh"), ("scan_x", "sw"), ("det_y", "dh"), ("det_x", "dw"))))
    both = datasets.join(found, "dataset_id", "left")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("sh", "scan_h"), ("sw", "scan_w"), ("dh", "det_h"), ("dw", "det_w"))]
    return both.select("dataset_id", (same[0] & same[1] & same[2] & same[3]).alias("extents_equal"), F.coalesce(F.col("dh") == 1, F.lit(False)).alias("is_spectra"))


def expected_positions(datasets: DataFrame) -> DataFrame:
    """Every frame of a catalog's data sets (dataset_id, n_frames), generated row by row."""
    return datasets.where("n_frames > 0").select("dataset_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame_idx"))


def missing_frames(received: DataFrame, datasets: DataFrame) -> DataFrame:
    return expected_positions(datasets).join(received.select("dataset_id", "frame_idx"), ["dataset_id", "frame_idx"], "left_anti")


def completeness(received: DataFrame, datasets: DataFrame, lo: int, hi: int) -> DataFrame:
    """Received frames of each data set, their percentage, and whether the region lo to hi (excluded) is complete.

    Counts of what came, not the list of what should: nothing the size of the scan is generated."""
    got = received.join(datasets, "dataset_id", "left_semi").select("dataset_id", "frame_idx").distinct()
    got = got.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("received"), F.count_if((F.col("frame_idx") >= lo) & (F.col("frame_idx") < hi)).alias("in_region"))
    out = datasets.select("dataset_id", "n_frames").join(got, "dataset_id", "left").na.fill(0, ["received", "in_region"])
    return out.select("dataset_id", "received", (100 * F.col("received") / F.col("n_frames")).alias("percent"), (F.col("in_region") == hi - lo).alias("region_ready"))


def frame_pattern_check(frames: DataFrame, modulus: int = 100, least: float = 0.99) -> DataFrame:
    """Share of frames whose pixels all hold frame_idx % modulus, and whether it is enough."""
    good = F.forall("counts", lambda c: c == F.col("frame_idx") % modulus)
    return frames.groupBy("dataset_id").agg(F.avg(good.cast("int")).alias("share")).withColumn("passes", F.col("share") >= least)
