"""What a catalog of acquisitions tells without reading pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER_BYTES = 384
#: How far codecs shrink cubes, by codec and level.
CODEC_RATIOS = [("gzip-1", 20.1), ("gzip-6", 26.4), ("gzip-9", 28.9), ("szip", 23.5), ("lzf", 14.0), ("none", 0.8)]
GIB = 1 << 30


def frame_position(index: Column, scan_w: Column) -> tuple[Column, Column]:
    """Scan row and column of a frame: the whole scan's width counts, whatever part is read."""
    return F.floor(index / scan_w).cast("int"), (index % scan_w).cast("int")


def frame_count(datasets: DataFrame, bytes_per_pixel: int = 2, header: int = HEADER_BYTES) -> DataFrame:
    """Whole records in a file of file_size bytes."""
    size = header + bytes_per_pixel * F.col("det_h").cast("long") * F.col("det_w")
    return datasets.withColumn("frames", F.floor(F.col("file_size") / size).cast("long"))


def infer_scan_size(datasets: DataFrame) -> DataFrame:
    """dataset_id, scan_h, scan_w of n_frames: of all factor pairs that with the least aspect ratio, the smaller first."""
    root = F.floor(F.sqrt(F.col("n_frames").cast("double"))).cast("long")
    pairs = datasets.where("n_frames > 0").select("dataset_id", "n_frames", F.explode(F.sequence(F.lit(1).cast("long"), root)).alias("i")).where("n_frames % i = 0")
    largest = pairs.groupBy("dataset_id", "n_frames").agg(F.max("i").alias("i"))  # the largest factor up to the root
    size = largest.select("dataset_id", F.col("i").cast("int").alias("h"), F.expr("cast(n_frames div i as int)").alias("w"))
    best = size.groupBy("dataset_id").agg(F.max(F.shiftleft(F.col("h").cast("long"), 32) + F.col("w")).alias("b"))  # a number, as the greatest struct is found by sorting
    return best.select("dataset_id", F.shiftright("b", 32).cast("int").alias("scan_h"), (F.col("b") % (1 << 32)).cast("int").alias("scan_w"))


def valid_bin_factors(size: Column) -> Column:
    """Powers of two up to 512 that divide a detector's size."""
    return F.filter(F.array(*(F.lit(1 << k) for k in range(10))), lambda f: (f <= size) & (size % f == 0))


def experiment_type(datasets: DataFrame) -> DataFrame:
    """EELS for rectangular detectors, 4D_STEM for square ones, and what may be done with each."""
    h, w = F.col("det_h"), F.col("det_w")
    rectangular, can_sum = h != w, (h != w) & (F.least(h, w) > 1)
    detector = F.when(rectangular, "EELS spectrometer").when(h >= 512, "Quad detector").otherwise("Single detector")
    advice = F.when(can_sum, "sum_y").when(rectangular, "none").otherwise("bin_2x2")
    return datasets.select(
        "dataset_id", F.when(rectangular, "EELS").otherwise("4D_STEM").alias("experiment_type"), can_sum.alias("can_sum_y"), (~rectangular).alias("can_bin"), detector.alias("detector"), advice.alias("recommended")
    )


def processed_shape(datasets: DataFrame, bin_factor: int = 1, sum_y: bool = False) -> DataFrame:
    """Detector extents after binning and summing over rows, and by how much the cube shrinks."""
    h = F.lit(1) if sum_y else F.floor(F.col("det_h") / bin_factor).cast("int")
    w = F.floor(F.col("det_w") / bin_factor).cast("int")
    before, after = F.col("det_h").cast("long") * F.col("det_w"), h.cast("long") * w
    return datasets.select("dataset_id", h.cast("int").alias("out_h"), w.alias("out_w"), F.when(after > 0, before / after).otherwise(F.lit(1.0)).alias("reduction"))


def storage_estimate(datasets: DataFrame, bin_factor: int = 1, sum_y: bool = False) -> DataFrame:
    """Expected bytes and seconds of a conversion, for every codec; `eels_bytes` is the estimate for saved spectra."""
    spark = datasets.sparkSession
    codecs = F.broadcast(spark.createDataFrame(CODEC_RATIOS, "codec string, ratio double"))  # six rows
    shaped = datasets.join(processed_shape(datasets, bin_factor, sum_y), "dataset_id").crossJoin(codecs)
    gb = F.col("file_size") / GIB
    processed = F.col("file_size") / F.col("reduction")
    final = F.when(F.col("ratio") > 1, processed / F.col("ratio")).otherwise(processed * 1.25)
    seconds = F.greatest(F.lit(5), F.floor(gb * 10 * (1.2 if bin_factor > 1 or sum_y else 1.0)).cast("int"))
    eels = F.col("file_size") / 4 + 10 * 1024 * 1024
    return shaped.select("dataset_id", "codec", F.round(final, 3).alias("out_bytes"), F.round(F.col("file_size") / final, 6).alias("total_reduction"), seconds.alias("seconds"), eels.alias("eels_bytes"))


def fft_size_estimate(datasets: DataFrame, crop: int) -> DataFrame:
    """Bytes of a cube and of its transform, whole and cropped to crop x crop detector pixels."""
    n = F.col("n_frames") * F.col("det_h") * F.col("det_w")
    part = F.col("n_frames") * F.least(F.col("det_h"), F.lit(crop)) * F.least(F.col("det_w"), F.lit(crop))
    return datasets.select("dataset_id", (2 * n).alias("cube_bytes"), (16 * n).alias("fft_bytes"), (16 * part).alias("cropped_fft_bytes"), (n / part).alias("reduction"))


def recommended_bin_factor(datasets: DataFrame, budget_bytes: int) -> DataFrame:
    """The valid factor next to the least that brings a cube under 0.9 of the budget; the smaller of two as near."""
    need = F.col("n_frames") * F.col("det_h") * F.col("det_w") * 2
    optimum = F.ceil(F.sqrt(need / (0.9 * budget_bytes))).cast("int")
    factors = datasets.select("dataset_id", optimum.alias("optimum"), F.explode(valid_bin_factors(F.least("det_h", "det_w"))).alias("f"))
    near = F.coalesce(F.abs(F.col("f") - F.col("optimum")).cast("long") * 1024, F.lit(0)) + F.col("f")  # by distance, then by factor, of at most 512; a least struct is found by sorting
    best = factors.groupBy("dataset_id", "optimum").agg(F.min(near).alias("b"))
    return best.select("dataset_id", "optimum", (F.col("b") % 1024).cast("int").alias("bin_factor"))


def slice_sizes(datasets: DataFrame, bytes_per_pixel: int = 2) -> DataFrame:
    """Bytes of one diffraction pattern, of one detector pixel's scan image, and of one detector row."""
    return datasets.select(
        "dataset_id",
        (F.col("det_h").cast("long") * F.col("det_w") * bytes_per_pixel).alias("pattern_bytes"),
        (F.col("n_frames") * bytes_per_pixel).alias("pixel_image_bytes"),
        (F.col("det_w").cast("long") * bytes_per_pixel).alias("row_bytes"),
    )


def default_detectors(datasets: DataFrame) -> DataFrame:
    """Centre and radii of the virtual bright-field disk and dark-field annulus of a detector."""
    side = F.least("det_h", "det_w")
    half = lambda c, n: F.floor(c / n).cast("int")
    return datasets.select(
        "dataset_id", half(F.col("det_h"), 2).alias("cy"), half(F.col("det_w"), 2).alias("cx"), half(side, 8).alias("bf_radius"), half(side, 6).alias("df_inner"), half(side, 4).alias("df_outer")
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each data set; of equal times the greatest run_id."""
    newest = runs.groupBy("dataset_id").agg(F.max(F.struct("ts", "run_id", "step_completed")).alias("r"))
    return newest.select("dataset_id", "r.run_id", "r.ts", "r.step_completed")


def run_info(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """Every run with the size of its stage tables and which of them are there. stages: run_id, stage, size_bytes."""
    there = stages.groupBy("run_id").agg(F.sum("size_bytes").alias("size_bytes"), F.bool_or(F.col("stage") == "bigft").alias("has_bigft"), F.bool_or(F.col("stage") == "correlations").alias("has_correlations"))
    out = runs.join(there, "run_id", "left")
    return out.select("run_id", "dataset_id", "ts", "step_completed", F.coalesce("size_bytes", F.lit(0).cast("long")).alias("size_bytes"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_bigft", "has_correlations")))


def run_params_match(stored: DataFrame, wanted: DataFrame, params: list[str]) -> DataFrame:
    """Which stored parameters differ from those wanted for a data set; nulls equal nulls."""
    pairs = stored.select("run_id", "dataset_id", *(F.col(p).alias(f"stored_{p}") for p in params)).join(wanted.select("dataset_id", *params), "dataset_id")
    same = [F.col(f"stored_{p}").eqNullSafe(F.col(p)) for p in params]
    differing = F.filter(F.array(*(F.when(~s, F.lit(p)) for s, p in zip(same, params, strict=True))), lambda x: x.isNotNull())
    return pairs.select("run_id", "dataset_id", (F.size(differing) == 0).alias("matches"), differing.alias("differing"))


STEPS = ["detect", "fft", "correlate", "shifts", "reconstruct"]


def resume_stage(runs: DataFrame) -> DataFrame:
    """The step a run may do next, null if all five are done."""
    done = F.col("step_completed")
    step = F.element_at(F.array(*map(F.lit, STEPS)), F.least(done + 1, F.lit(len(STEPS))))
    return runs.select("run_id", "dataset_id", "step_completed", F.when(done < len(STEPS), step).alias("next_step"))


def invalidate_after(stages: DataFrame, runs: DataFrame) -> DataFrame:
    """Stage tables that count: those up to the step that their run has completed. stages: run_id, step, ..."""
    return stages.join(runs.select("run_id", "step_completed"), "run_id").where(F.col("step") <= F.col("step_completed"))


def preferred_result(results: DataFrame, probes: DataFrame) -> DataFrame:
    """For each data set the result to load: usable ones (some sample isn't zero), cropped before full.

    results: dataset_id, mode; probes: dataset_id, mode, re, im (a small sample of each)."""
    usable = probes.groupBy("dataset_id", "mode").agg(F.bool_or((F.col("re") != 0) | (F.col("im") != 0)).alias("usable"))
    w = Window.partitionBy("dataset_id").orderBy(F.when(F.col("mode") == "cropped", 0).otherwise(1), "mode")  # a data set has a few modes
    return results.join(usable, ["dataset_id", "mode"]).where("usable").withColumn("k", F.row_number().over(w)).where("k = 1").select("dataset_id", "mode")
