"""Every query of the library by name, with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import scalar, tables
from ..operators import align, detect, geometry, layout, meta, select, spectral, stats, strips
from ..sources import cubes, footers, mib, scratch, tiles
from ..streaming import frames as live
from . import oracles, superres
from .runs import RunStore

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.SQL.items() if name in _QUERIES}


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero, so that the order of sums doesn't show."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def _size(spark: SparkSession, sf: str) -> tuple[int, int]:
    """Scan extents of the fixture cube: one row of the catalog."""
    r = fx.extents(fx.table(spark, sf, "embeddings"), "emb", 8, 8).first()
    return r.scan_h, r.scan_w


def _voxels(spark: SparkSession, sf: str) -> DataFrame:
    return layout.explode_voxels(fx.frames(spark, sf))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return layout.pixel_images(fx.frames(spark, sf), *_size(spark, sf))


def _context(spark: SparkSession, sf: str) -> DataFrame:
    return fx.context(spark, sf).select("dataset_id", F.col("scan_y").alias("y"), F.col("scan_x").alias("x"), F.col("value").cast("double").alias("value"))


def _mean_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-number pattern: the sum over the scan."""
    return detect.sum_pattern(fx.frames(spark, sf)).select("dataset_id", "det_y", "det_x", F.col("total").alias("value"))


def _shift_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """Half-pixel shifts and qualities for every detector pixel, from the sums of its image."""
    h, w = _size(spark, sf)
    total = F.col("value")
    return _mean_pattern(spark, sf).select(
        "dataset_id", "det_y", "det_x", ((total % 9 - 4) / 2 + h // 2).alias("shift_y"), ((total % 7 - 3) / 2 + w // 2).alias("shift_x"), ((total % 100) / 100).alias("quality")
    )


def _voxel_sums(frames: DataFrame) -> DataFrame:
    """Frames as voxels, for comparison."""
    rows = layout.explode_voxels(frames)
    return rows.withColumn("count", F.col("count").cast("long"))


# --- sources and sinks -----------------------------------------------------------------------------------------------


def _mib_folder(spark: SparkSession, sf: str) -> str:
    folder = scratch.fresh(spark, "mib")
    mib.write_mib(fx.frames(spark, sf), folder, 100).write.format("noop").mode("overwrite").save()
    mib.register(spark)
    return folder


@query
def read_mib(spark, sf):
    rows = spark.read.format("mib").load(_mib_folder(spark, sf))
    return rows.select("dataset_id", "frame_idx", "scan_y", "scan_x", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("value"), "truncated")


@query
def read_mib_rows(spark, sf):
    """Filters on the scan position choose the frames that are read."""
    rows = spark.read.format("mib").load(_mib_folder(spark, sf)).where("scan_y = 2 and scan_x >= 3")
    return rows.select("dataset_id", "frame_idx", F.get("counts", 9).alias("value"))


@query
def mib_headers(spark, sf):
    rows = spark.read.format("mib").option("mode", "header").load(_mib_folder(spark, sf))
    return rows.select("dataset_id", "file_size", "header_bytes", "det_h", "det_w", "pixel", "n_frames", "tail_bytes")


@query
def file_catalog(spark, sf):
    return cubes.file_catalog(spark, _mib_folder(spark, sf)).select("dataset_id", "n_frames", "det_h", "det_w", "experiment_type", "compatible", "error")


@query
def read_cube(spark, sf):
    path = scratch.fresh(spark, "cube")
    cubes.write_cube(fx.frames(spark, sf), path)
    return detect.scan_overview(cubes.read_cube(spark, path))


@query
def write_cube(spark, sf):
    path = scratch.fresh(spark, "cube")
    cubes.write_cube(fx.frames(spark, sf), path, codec="snappy")
    return _voxel_sums(spark.read.parquet(path))


@query
def write_spectra(spark, sf):
    path = scratch.fresh(spark, "spectra")
    cubes.write_spectra(detect.process_cube(fx.eels(spark, sf), sum_rows=True, flip=True), path)
    out = spark.read.parquet(path).select("dataset_id", "scan_y", "scan_x", F.posexplode("spectrum").alias("channel", "value"))
    return out.withColumn("value", F.col("value").cast("double"))


@query
def verify_written(spark, sf):
    path = scratch.fresh(spark, "cube")
    cubes.write_cube(fx.frames(spark, sf), path)
    return cubes.verify_written(spark, path, fx.extents(fx.table(spark, sf, "embeddings"), "emb", 8, 8))


@query
def verify_incomplete(spark, sf):
    """Of a cube with every seventh frame left out, one that isn't there, and one with cut frames, none is well."""
    frames, path = fx.frames(spark, sf), scratch.fresh(spark, "cube")
    cut = F.when(F.col("frame_idx") % 5 == 0, F.slice("counts", 1, 60)).otherwise(F.col("counts"))
    rows = frames.where("frame_idx % 7 <> 0").unionByName(frames.withColumns({"dataset_id": F.lit("cut"), "counts": cut}))
    cubes.write_cube(rows, path)
    sizes = fx.extents(fx.table(spark, sf, "embeddings"), "emb", 8, 8)
    return cubes.verify_written(spark, path, sizes.unionByName(sizes.withColumn("dataset_id", F.lit("cut"))).unionByName(sizes.withColumn("dataset_id", F.lit("none"))))


@query
def truncated_frames(spark, sf):
    """Detector files whose last frames are cut: each is read as far as it goes, and told."""
    folder, short = _mib_folder(spark, sf), scratch.fresh(spark, "mib")
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    cut = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.expr("substring(content, 1, length(content) - 100)").alias("content"))
    mib.write_files(cut, short).write.format("noop").mode("overwrite").save()
    return spark.read.format("mib").load(short).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("truncated").alias("cut"))


@query
def export_structure(spark, sf):
    """The inventory of a written table, through its JSON export."""
    path, out = scratch.fresh(spark, "frames"), scratch.fresh(spark, "structure")
    fx.frames(spark, sf).write.parquet(path)
    cubes.export_structure(cubes.structure_inventory(spark, {"frames": path}), out)
    return spark.read.schema("`table` string, n_rows long, `column` string, `type` string").json(out)


def _ndata_file(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A row of the context image as a zip file of an array and its metadata."""
    image, out = io.BytesIO(), io.BytesIO()
    np.save(image, rows.sort_values("scan_x")["value"].to_numpy()[None, :])
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("data.npy", image.getvalue())
        z.writestr("metadata.json", json.dumps({"row": int(key[0])}))
    return pd.DataFrame({"name": [f"row-{key[0]}.ndata1"], "content": [out.getvalue()]})


@query
def read_ndata(spark, sf):
    """Context images of one scan row each, written as files and read back."""
    folder = scratch.fresh(spark, "ndata")
    files = fx.context(spark, sf).groupBy("scan_y").applyInPandas(_ndata_file, "name string, content binary")
    mib.write_files(files, folder).write.format("noop").mode("overwrite").save()
    return cubes.read_ndata(spark, folder)


@query
def write_fft_result(spark, sf):
    path = scratch.fresh(spark, "fft")
    freqs = spectral.frequencies(spectral.fft_scan(_images(spark, sf)))
    cubes.write_fft_result(freqs, path, "full")
    low = cubes.read_cached_result(spark, path, "mode = 'full'", "ky < 2 and kx < 3")
    return _round(low.select("dataset_id", "det_y", "det_x", "ky", "kx", "re", "im"), "re", "im", digits=4)


@query
def cached_slice(spark, sf):
    """A box of a hundredth of a cached result: what it holds, and that its row groups are less than a tenth of all."""
    path = scratch.fresh(spark, "fft")
    h, w = _size(spark, sf)
    cubes.write_fft_result(spectral.frequencies(spectral.fft_scan(_images(spark, sf))), path, "full", 1 << 11)
    box = {"ky": (0, -(-h // 4) - 1), "kx": (0, -(-w // 4) - 1), "det_y": (0, 2), "det_x": (0, 2)}
    found = cubes.read_cached_result(spark, path, *(f"{c} between {lo} and {hi}" for c, (lo, hi) in box.items()))
    groups = footers.overlapping(footers.row_groups(spark, path), box)
    share = groups.agg((F.count_if("needed") < F.count(F.lit(1)) / 10).alias("few_groups"))
    return found.agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("re"), 1) + 0.0).alias("re")).crossJoin(share)  # one row each


@query
def structure_statistics(spark, sf):
    path = scratch.fresh(spark, "frames")
    fx.frames(spark, sf).write.parquet(path)
    out = cubes.structure_statistics(spark, {"frames": path}).where("column in ('counts', 'frame_idx', 'scan_y')")
    return _round(out, "lo", "hi", "mean", "sd", digits=4)


@query
def detect_results(spark, sf):
    modes = fx.datasets(spark, sf).select("dataset_id", F.explode(F.array(F.lit("full"), F.lit("cropped"))).alias("mode"), "n_frames")
    probes = modes.select("dataset_id", "mode", F.when((F.col("mode") == "full") | (F.col("n_frames") % 3 == 0), F.col("n_frames") % 2).otherwise(0).cast("double").alias("re"), F.lit(0.0).alias("im"))
    return meta.preferred_result(modes.select("dataset_id", "mode"), probes)


@query
def structure_inventory(spark, sf):
    tables = {}
    for name, df in (("frames", fx.frames(spark, sf)), ("sparse", layout.sparse_frames(fx.frames(spark, sf)))):
        tables[name] = scratch.fresh(spark, name)
        df.write.parquet(tables[name])
    return cubes.structure_inventory(spark, tables).select("table", "n_rows", "column", "type")


@query
def codec_study(spark, sf):
    """What each layout and codec holds by three reads; compression saves bytes, and so do narrow types."""
    study = cubes.codec_study(scratch.kept(fx.frames(spark, sf), "frames"), scratch.fresh(spark, "codecs"), budget=8192)
    return study.select("codec", "layout", "raw_bytes", "frame_sum", "pixel_sum", "region_sum", (F.abs(F.col("ratio") * F.col("size_bytes") - F.col("raw_bytes")) < 1).alias("ratio_of_files"))


@query
def read_tiles(spark, sf):
    """A box of scan positions and detector pixels, from tiles whose borders it crosses."""
    path = scratch.fresh(spark, "tiles")
    tiles.write_tiles(fx.frames(spark, sf), path, (4, 5, 3, 8))
    return tiles.read_tiles(spark, path, "emb", (2, 9, 3, 12), (1, 7, 0, 5)).drop("dataset_id")


@query
def rank_layouts(spark, sf):
    """Three layouts of the voxels by their bytes: two bytes each, one byte with a side table, places and values of those
    that aren't 0."""
    n, over, some = F.count(F.lit(1)), F.count_if(F.col("count") >= 255), F.count_if(F.col("count") > 0)
    size = _voxels(spark, sf).agg((2 * n).alias("raw_bytes"), F.array(F.struct(F.lit("u16").alias("codec"), (2 * n).alias("b")), F.struct(F.lit("u8").alias("codec"), (n + 13 * over).alias("b")), F.struct(F.lit("sparse").alias("codec"), (6 * some).alias("b"))).alias("l"))
    sizes = size.select("raw_bytes", F.explode("l").alias("l")).select("l.codec", F.lit("voxel").alias("layout"), F.col("l.b").alias("size_bytes"), "raw_bytes")
    ranked = stats.rank_layouts(sizes)
    place = F.row_number().over(Window.orderBy(F.desc("ratio"), "codec"))  # three rows
    return _round(ranked.select("codec", "layout", "size_bytes", "ratio", place.alias("place")), "ratio")


@query
def run_stages(spark, sf):
    """Stage tables of a run of the pipeline, and what the registry says of it."""
    store = RunStore(spark, scratch.fresh(spark, "runs"))
    superres.superres(fx.frames(spark, sf), _whole(spark, sf), lims=3, threshold=0.1, store=store, run_id="r1")
    info = meta.run_info(store.runs().drop("params"), store.stages())
    sizes = [F.lit(spark.read.parquet(store.path("r1", step)).count()).alias(n) for step, n in ((2, "n_images"), (4, "n_shifts"), (5, "n_pixels"))]
    return info.select("run_id", "dataset_id", "step_completed", "has_bigft", "has_correlations", *sizes)


@query
def purge_runs(spark, sf):
    """A run for each region, its nations as a stage; those of odd keys are purged and the stages of the others stay."""
    store = RunStore(spark, scratch.fresh(spark, "runs"))
    nations = fx.table(spark, sf, "nation").select("n_regionkey", "n_name")
    regions = sorted(r[0] for r in fx.table(spark, sf, "region").select("r_regionkey").collect())
    for key in regions:
        store.start(f"r{key}", "nations", {})
        store.write_stage(f"r{key}", "nations", 2, nations.where(F.col("n_regionkey") == key), {})
    store.purge("cast(substring(run_id, 2) as int) % 2 = 1")
    left = spark.read.option("basePath", f"{store.folder}/bigft").parquet(f"{store.folder}/bigft").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    found = store.runs().select("run_id", "step_completed").join(store.stages().select("run_id", "stage"), "run_id")
    return found.join(left, "run_id")


# --- metadata --------------------------------------------------------------------------------------------------------


@query
def frame_count(spark, sf):
    return meta.frame_count(fx.datasets(spark, sf)).select("dataset_id", "frames")


@query
def infer_scan_size(spark, sf):
    return meta.infer_scan_size(fx.datasets(spark, sf))


@query
def experiment_type(spark, sf):
    return meta.experiment_type(fx.datasets(spark, sf))


@query
def valid_bin_factors(spark, sf):
    return fx.datasets(spark, sf).select("dataset_id", F.explode(meta.valid_bin_factors(F.col("det_h"))).alias("factor"))


@query
def processed_shape(spark, sf):
    return _round(meta.processed_shape(fx.datasets(spark, sf), 2, True), "reduction")


@query
def storage_estimate(spark, sf):
    return _round(meta.storage_estimate(fx.datasets(spark, sf), 2), "eels_bytes", digits=3)


@query
def fft_size_estimate(spark, sf):
    return _round(meta.fft_size_estimate(fx.datasets(spark, sf), 64), "reduction")


@query
def recommended_bin_factor(spark, sf):
    return meta.recommended_bin_factor(fx.datasets(spark, sf), 1 << 20)


@query
def slice_sizes(spark, sf):
    return meta.slice_sizes(fx.datasets(spark, sf))


@query
def default_detectors(spark, sf):
    return meta.default_detectors(fx.datasets(spark, sf))


@query
def latest_run(spark, sf):
    return meta.latest_run(fx.runs(spark, sf)).select("dataset_id", "run_id", "step_completed")


def _stage_rows(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("detect"), F.lit("bigft"), F.lit("correlations"), F.lit("shifts"), F.lit("reconstruction"))
    rows = fx.runs(spark, sf).select("run_id", F.posexplode(names).alias("k", "stage"))
    rows = rows.where((F.col("run_id") + F.col("k")) % 3 != 0)
    return rows.select("run_id", (F.col("k") + 1).alias("step"), "stage", ((F.col("run_id") % 1000) * (F.col("k") + 1)).cast("long").alias("size_bytes"))


@query
def run_info(spark, sf):
    return meta.run_info(fx.runs(spark, sf), _stage_rows(spark, sf)).drop("ts")


@query
def run_params_match(spark, sf):
    runs = fx.runs(spark, sf)
    stored = runs.select("run_id", "dataset_id", F.when(F.col("run_id") % 4 != 0, F.col("run_id") % 3).alias("radius"), (F.col("run_id") % 2).alias("crop"))
    wanted = runs.select("dataset_id").distinct().select("dataset_id", F.when(F.col("dataset_id") % 4 != 0, F.col("dataset_id") % 3).alias("radius"), (F.col("dataset_id") % 2).alias("crop"))
    out = meta.run_params_match(stored, wanted, ["radius", "crop"])
    return out.withColumn("differing", F.array_join("differing", ","))


@query
def resume_stage(spark, sf):
    return meta.resume_stage(fx.runs(spark, sf))


@query
def invalidate_after(spark, sf):
    return meta.invalidate_after(_stage_rows(spark, sf), fx.runs(spark, sf)).select("run_id", "step", "stage")


# --- selection -------------------------------------------------------------------------------------------------------


@query
def explode_voxels(spark, sf):
    return _voxels(spark, sf)


@query
def frames_from_voxels(spark, sf):
    """Back from event-mode voxels: empty pixels are 0."""
    rows = fx.sparse(spark, sf)
    return detect.scan_overview(layout.frames_from_voxels(rows, 16, 16, 1))


@query
def diffraction_pattern(spark, sf):
    return layout.explode_voxels(select.diffraction_pattern(fx.frames(spark, sf), 3, 9999))


@query
def detector_pixel_image(spark, sf):
    return layout.detector_pixel_image(fx.frames(spark, sf), 3, 5)


@query
def standard_bf(spark, sf):
    return layout.standard_bf(fx.frames(spark, sf))


@query
def crop_detector(spark, sf):
    bounds = select.crop_bounds(3.7, 4.2, 3, 8, 8)
    return layout.explode_voxels(select.crop_detector(fx.frames(spark, sf), *bounds))


@query
def crop_voxels(spark, sf):
    return select.crop_voxels(fx.sparse(spark, sf), 4, 10, 2, 9)


@query
def crop_scan(spark, sf):
    h, w = _size(spark, sf)
    return detect.scan_overview(select.crop_scan(fx.frames(spark, sf), 6, 9, h, w))


@query
def unscramble_eels(spark, sf):
    tall = fx.frames(spark, sf, "eels", 16, 4)
    return layout.explode_voxels(select.unscramble_eels(tall))


@query
def flip_energy(spark, sf):
    return layout.explode_voxels(select.flip_energy(fx.eels(spark, sf)))


@query
def roi_filter(spark, sf):
    h, w = _size(spark, sf)
    return detect.scan_overview(select.roi_rectangle(fx.frames(spark, sf), 2, 3, 5, 999, h, w))


@query
def roi_rotated(spark, sf):
    return detect.scan_overview(select.roi_rotated(fx.frames(spark, sf), 10, 12, 4, 9, 30))


@query
def line_profile(spark, sf):
    return select.line_profile(_voxels(spark, sf), 4)


@query
def threshold_frame(spark, sf):
    return layout.explode_voxels(select.threshold_frame(fx.frames(spark, sf), 0.5))


@query
def threshold_mask(spark, sf):
    return layout.explode_voxels(select.threshold_mask(fx.frames(spark, sf), 0.5))


@query
def fftshift_coords(spark, sf):
    h, w = _size(spark, sf)
    at = fx.frames(spark, sf)
    return at.select("scan_y", "scan_x", select.fftshift(F.col("scan_y"), h).alias("shown_y"), select.fftshift(F.col("scan_x"), w).alias("shown_x"), select.display_to_stored(F.col("scan_x"), w).alias("stored_x"))


@query
def sample_positions(spark, sf):
    return select.sample_positions(fx.frames(spark, sf), 50)


@query
def first_frames(spark, sf):
    return detect.scan_overview(select.first_frames(fx.frames(spark, sf), 100))


@query
def pixel_difference(spark, sf):
    return select.pixel_difference(fx.frames(spark, sf), (3, 3), (4, 5), 2, -1)


@query
def disk_mask(spark, sf):
    """Disk and annulus as tables, joined to the pattern that they cover."""
    disk = select.disk_mask(spark, 8, 8, 4, 4, 2).withColumn("part", F.lit("disk"))
    ring = select.annulus_mask(spark, 8, 8, 4, 4, 2, 3).withColumn("part", F.lit("annulus"))
    return _mean_pattern(spark, sf).join(disk.unionByName(ring), ["det_y", "det_x"]).select("part", "det_y", "det_x", "value")


@query
def masks_in_sql(spark, sf):
    """disk_mask in SQL text alone: table functions of the session."""
    tables.register(spark)
    _mean_pattern(spark, sf).createOrReplaceTempView("mean_pattern")
    return spark.sql("""
        SELECT 'disk' AS part, det_y, det_x, value FROM mean_pattern JOIN disk_mask(8, 8, 4, 4, 2) USING (det_y, det_x) UNION ALL
        SELECT 'annulus', det_y, det_x, value FROM mean_pattern JOIN annulus_mask(8, 8, 4, 4, 2, 3) USING (det_y, det_x)""")


@query
def last_write_per_target(spark, sf):
    """Shifted pixels of all images written to a grid half as fine: of each place the last image's value stays."""
    rows = _voxels(spark, sf).select("dataset_id", F.expr("int((scan_y + det_y) div 2)").alias("y"), F.expr("int((scan_x + det_x) div 2)").alias("x"), "det_y", "det_x", "scan_y", "scan_x", F.col("count").alias("value"))
    return align.last_write_per_target(rows, ["dataset_id", "y", "x"], ["det_y", "det_x", "scan_y", "scan_x"])


# --- joins and sets --------------------------------------------------------------------------------------------------


@query
def apply_mask(spark, sf):
    return detect.apply_mask(_voxels(spark, sf), select.disk_mask(spark, 8, 8, 4, 4, 2))


@query
def mask_frames(spark, sf):
    """A weighted ring by runs of pixels, on frames."""
    mask = select.annulus_mask(spark, 8, 8, 4, 4, 1, 3).withColumn("w", F.col("det_y") + 2 * F.col("det_x"))
    return detect.mask_frames(fx.frames(spark, sf), mask)


@query
def apply_weights(spark, sf):
    mask = select.annulus_mask(spark, 8, 8, 4, 4, 1, 3).withColumn("w", F.col("det_y") + 2 * F.col("det_x"))
    return detect.apply_mask(_voxels(spark, sf), mask)


@query
def join_context_image(spark, sf):
    image = detect.scan_overview(fx.frames(spark, sf)).withColumnRenamed("value", "total")
    return detect.join_context_image(image, fx.context(spark, sf))


@query
def join_reference_fft(spark, sf):
    """Transforms of all pixels times the conjugate of the first pixel's."""
    freqs = spectral.frequencies(spectral.fft_scan(_images(spark, sf)))
    out = spectral.join_reference_fft(freqs, freqs.where("det_y = 0 and det_x = 0")).drop("dataset_id")
    return _round(out, "re", "im", digits=1)


@query
def join_shift_map(spark, sf):
    out = align.join_shift_map(_images(spark, sf), _shift_fixture(spark, sf), 0.3)
    return _round(out.select("det_y", "det_x", "shift_y", "shift_x", "quality", F.aggregate("img", F.lit(0.0), lambda a, v: a + v).alias("total")), "quality")


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    frames = fx.frames(spark, sf)
    return stats.compare_frames(frames, fx.damaged(frames))


@query
def compare_voxels(spark, sf):
    """Two event-mode cubes, voxel by voxel: each lacks some that the other has."""
    rows = fx.sparse(spark, sf)
    some = lambda k: rows.where(f"(scan_y + scan_x * 3 + det_y * 5 + det_x) % 7 <> {k}")
    return stats.compare_cubes(some(1), some(2)).where("missing_a or missing_b")


@query
def compare_cubes(spark, sf):
    return _compared(spark, sf).where("a <> b or missing_a or missing_b")


@query
def sampled_match_rate(spark, sf):
    frames = fx.frames(spark, sf)
    at = layout.explode_voxels(frames).where("(scan_y * 7 + scan_x * 3 + det_y * 5 + det_x) % 11 = 0")
    return _round(stats.sampled_match_rate(at, frames, fx.damaged(frames)), "percent_equal")


@query
def interpolation_neighbours(spark, sf):
    return _round(align.interpolation_neighbours(_context(spark, sf), 0.5, -0.25), "value")


@query
def opposing_pixels(spark, sf):
    ring = select.annulus_mask(spark, 8, 8, 4, 4, 2, 3)
    pairs = align.opposing_pixels(ring, 4, 4)
    value = _mean_pattern(spark, sf).select("det_y", "det_x", "value")
    return pairs.join(value, ["det_y", "det_x"])


@query
def distinct_positions(spark, sf):
    return select.distinct_positions(fx.sparse(spark, sf), 200)


@query
def union_parts(spark, sf):
    frames = fx.frames(spark, sf)
    parts = [frames.where(F.col("frame_idx") % 3 == k) for k in range(3)]
    return detect.scan_overview(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _arrival_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.arrivals(spark, sf)
    n = rows.agg(F.count(F.lit(1)).alias("n_frames"))
    return rows.select("dataset_id").distinct().crossJoin(F.broadcast(n))  # one row


@query
def missing_frames(spark, sf):
    return stats.missing_frames(fx.arrivals(spark, sf), _arrival_sets(spark, sf))


@query
def completeness(spark, sf):
    return _round(stats.completeness(fx.arrivals(spark, sf), _arrival_sets(spark, sf), 0, 3), "percent")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query
def scan_overview(spark, sf):
    return detect.scan_overview(fx.frames(spark, sf))


@query
def virtual_bf(spark, sf):
    return detect.virtual_bf(fx.frames(spark, sf), 4, 4, 1)


@query
def virtual_df(spark, sf):
    return detect.virtual_df(fx.frames(spark, sf), 4, 4, 2, 3)


@query
def virtual_bf_events(spark, sf):
    """Bright field of an event-mode cube, through the mask as a table."""
    return detect.apply_mask(fx.sparse(spark, sf), select.disk_mask(spark, 16, 16, 8, 8, 5))


@query
def mean_bf(spark, sf):
    return _round(detect.mean_bf(fx.frames(spark, sf)), "value")


@query
def energy_window_image(spark, sf):
    return detect.energy_window_image(fx.eels(spark, sf), 10, 200)


@query
def roi_spectrum(spark, sf):
    h, w = _size(spark, sf)
    return _round(detect.roi_spectrum(select.roi_rectangle(fx.eels(spark, sf), 2, 2, 9, 9, h, w)), "value")


@query
def sum_pattern(spark, sf):
    return _round(detect.sum_pattern(fx.frames(spark, sf)), "mean")


@query
def bin_detector(spark, sf):
    out = layout.explode_voxels(detect.bin_detector(fx.frames(spark, sf), 2, "mean"))
    return _round(out, "count")


@query
def bin_detector_sum(spark, sf):
    return layout.explode_voxels(detect.bin_detector(fx.frames(spark, sf), 4, "sum"))


@query
def sum_y(spark, sf):
    return layout.explode_voxels(detect.sum_y(fx.eels(spark, sf)))


@query
def process_cube(spark, sf):
    return layout.explode_voxels(detect.process_cube(fx.eels(spark, sf), 2, "sum", sum_rows=True, flip=True))


@query
def detector_energy(spark, sf):
    return detect.detector_energy(fx.frames(spark, sf))


@query
def bf_center_com(spark, sf):
    return _round(geometry.bf_center_com(fx.frames(spark, sf), 0.6), "cy", "cx")


@query
def bf_disk_bounds(spark, sf):
    return geometry.bf_disk_bounds(_mean_pattern(spark, sf), 0.5, 1)


@query
def radial_profile(spark, sf):
    return _round(geometry.radial_profile(_mean_pattern(spark, sf), 4, 4, 4), "value")


@query
def radial_frequency_profile(spark, sf):
    """Over the detector's own frequencies of the summed pattern's map: the map is 8 x 8."""
    rows = _mean_pattern(spark, sf).select("dataset_id", F.col("det_y").alias("ky"), F.col("det_x").alias("kx"), "value")
    return _round(geometry.radial_frequency_profile(rows, 8), "value")


@query
def radial_gradient(spark, sf):
    return _round(geometry.radial_gradient(geometry.radial_profile(_mean_pattern(spark, sf), 4, 4)), "gradient")


@query
def bf_radius(spark, sf):
    return geometry.bf_radius(geometry.radial_profile(_mean_pattern(spark, sf), 4, 4))


@query
def histogram(spark, sf):
    return stats.histogram(detect.virtual_bf(fx.frames(spark, sf), 4, 4, 2))


@query
def value_distribution(spark, sf):
    return stats.value_distribution(fx.sparse(spark, sf))


@query
def sparsity(spark, sf):
    return _round(stats.sparsity(layout.explode_voxels(fx.damaged(fx.frames(spark, sf)))), "sparsity")


@query
def quality_stats(spark, sf):
    return _round(stats.quality_stats(_shift_fixture(spark, sf)), "mean_q", "median_q", "min_q", "max_q")


@query
def dataset_stats(spark, sf):
    return _round(stats.dataset_stats(_voxels(spark, sf)), "mean", "sd")


@query
def cube_diff_stats(spark, sf):
    return _round(stats.cube_diff_stats(_compared(spark, sf)), "mean", "sd", "percent_differing")


@query
def corruption_by_radius(spark, sf):
    return stats.corruption_by_radius(_compared(spark, sf), 8, 8)


@query
def all_zero_check(spark, sf):
    rows = fx.datasets(spark, sf).select("dataset_id", (F.col("n_frames") % 2).alias("value"))
    return stats.all_zero_check(rows)


@query
def residual_stats(spark, sf):
    rows = _shift_fixture(spark, sf).select("dataset_id", F.col("shift_y").alias("ry"), F.col("shift_x").alias("rx"))
    return _round(stats.residual_stats(rows), "rmse_component", "rmse_vector", "mean", "greatest", "sd")


@query
def contrast_ratio(spark, sf):
    as_image = lambda t: t.select("dataset_id", F.col("scan_y").alias("y"), F.col("scan_x").alias("x"), F.col("value").cast("double").alias("value"))
    frames = fx.frames(spark, sf)
    return _round(stats.contrast_ratio(as_image(detect.virtual_bf(frames, 4, 4, 1)), as_image(layout.standard_bf(frames))), "ratio", "rmse")


@query
def throughput_stats(spark, sf):
    log = fx.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 10).cast("string").alias("dataset_id"), F.col("l_returnflag").alias("stage"), F.col("l_quantity").cast("long").alias("in_bytes"), F.col("l_linenumber").cast("long").alias("out_bytes"), F.lit(2).cast("long").alias("seconds")
    )
    return _round(stats.throughput_stats(log), "mb_per_s", "ratio")


@query
def shape_check(spark, sf):
    return stats.shape_check(_voxels(spark, sf), fx.extents(fx.table(spark, sf, "embeddings"), "emb", 8, 8))


@query
def frame_pattern_check(spark, sf):
    """Frames made to hold frame_idx % 100, with every fortieth spoilt."""
    rows = fx.frames(spark, sf).withColumn("counts", F.transform("counts", lambda c, k: F.when((F.col("frame_idx") % 40 == 39) & (k == 5), -1).otherwise((F.col("frame_idx") % 100).cast("int"))))
    return _round(stats.frame_pattern_check(rows), "share")


# --- windows and order -----------------------------------------------------------------------------------------------


@query
def frame_order(spark, sf):
    return layout.frame_order(fx.arrivals(spark, sf), 25).select("dataset_id", "frame_idx", "scan_y", "scan_x")


@query
def top_detector_pixels(spark, sf):
    return _round(align.top_detector_pixels(_shift_fixture(spark, sf), 0.5, 10), "quality")


@query
def pixel_usage(spark, sf):
    return _round(align.pixel_usage(_shift_fixture(spark, sf), 0.5), "best")


# --- scalar functions ------------------------------------------------------------------------------------------------


def _value(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    return fx.table(spark, sf, "events").select("event_id", F.col("value").cast("double").alias("v")), F.col("v")


@query
def complex_views(spark, sf):
    df, v = _value(spark, sf)
    re, im = v - 40, v * 0.5 - 10
    a, b = scalar.complex_mul_conj(re, im, im, re)
    return _round(df.select("event_id", scalar.complex_abs(re, im).alias("abs"), scalar.complex_phase(re, im).alias("phase"), scalar.complex_real(re, im).alias("real"), a.alias("mul_re"), b.alias("mul_im")), "abs", "phase", "real", "mul_re", "mul_im", digits=4)


@query
def log_scale(spark, sf):
    df, v = _value(spark, sf)
    kinds = ("log10_floor", "log10_offset", "ln_offset", "log1p")
    out = df.select("event_id", *(scalar.log_scale(F.abs(v), k).alias(k) for k in kinds), scalar.log_scale(v - 40, "signed_log10").alias("signed_log10"))
    return _round(out, *kinds, "signed_log10")


@query
def gamma_normalize(spark, sf):
    df, v = _value(spark, sf)
    span = F.broadcast(df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")))  # one row
    return _round(df.crossJoin(span).select("event_id", scalar.gamma_normalize(v, F.col("lo"), F.col("hi")).alias("value")), "value")


@query
def clip_and_round(spark, sf):
    df, v = _value(spark, sf)
    return df.select("event_id", scalar.clip(v, 10.0, 60.0).alias("clipped"), scalar.round_half_even(F.floor(v) + 0.5).alias("rounded"))


@query
def vector_magnitude_angle(spark, sf):
    df, v = _value(spark, sf)
    cy, cx = scalar.magnitude_clip(v - 40, v - 20, 30.0)
    out = df.select("event_id", scalar.magnitude(v - 40, v - 20).alias("magnitude"), scalar.angle_degrees(v - 40, v - 20).alias("degrees"), cy.alias("cy"), cx.alias("cx"))
    return _round(out, "magnitude", "degrees", "cy", "cx")


@query
def header_fields(spark, sf):
    header = F.concat_ws(",", F.lit("HDR"), F.col("dataset_id"), F.lit(" 00384 "), F.col("det_w").cast("string"), F.col("det_h").cast("string"))
    rows = fx.datasets(spark, sf).select("dataset_id", header.alias("h"))
    at = lambda k: scalar.header_field(F.col("h"), k)
    return rows.select("dataset_id", at(2).alias("size"), at(3).try_cast("int").alias("w"), at(4).try_cast("int").alias("h"), at(0).try_cast("int").alias("none"))


@query
def attr_json(spark, sf):
    raw = F.when(F.col("n_frames") % 2 == 0, F.concat(F.lit('{ "frames" : '), F.col("n_frames").cast("string"), F.lit(" }"))).otherwise(F.concat(F.lit("frames "), F.col("n_frames").cast("string")))
    return fx.datasets(spark, sf).select("dataset_id", scalar.attr_json(raw).alias("attr"))


@query
def run_timestamp(spark, sf):
    runs = fx.runs(spark, sf).withColumn("name", scalar.run_name(F.col("dataset_id"), F.col("ts")))
    return runs.select("run_id", "name", (scalar.run_timestamp(F.col("name")) == F.col("ts")).alias("same"))


@query
def saturating_split(spark, sf):
    _, over = layout.overflow_encoding(fx.sparse(spark, sf).withColumn("count", F.col("count") * 20))
    return over


@query
def overflow_encoding(spark, sf):
    return layout.overflow_summary(fx.sparse(spark, sf).withColumn("count", F.col("count") * 20))


@query
def sparse_frames(spark, sf):
    """Through the sparse form and back."""
    frames = fx.damaged(fx.frames(spark, sf))
    return _voxel_sums(layout.frames_from_sparse(layout.sparse_frames(frames)))


@query
def pixel_weights(spark, sf):
    u, v = F.col("det_y"), F.col("det_x")
    out = _mean_pattern(spark, sf).select(
        "det_y", "det_x", (scalar.hann_weight(u, 8) * scalar.hann_weight(v, 8)).alias("hann"), (scalar.gauss_weight(u, 8) * scalar.gauss_weight(v, 8)).alias("gauss"), scalar.radial_gauss_weight(u - 4, v - 4, 8, 8).alias("radial")
    )
    return _round(out, "hann", "gauss", "radial")


@query
def poly_terms(spark, sf):
    terms = scalar.poly_terms(F.col("det_y") - 4.0, F.col("det_x") - 4.0, 3)
    return _mean_pattern(spark, sf).select("det_y", "det_x", *(t.alias(f"t{k}") for k, t in enumerate(terms)))


# --- spectra ---------------------------------------------------------------------------------------------------------


@query
def fft_scan(spark, sf):
    """Energy of every pixel's transform, which by Parseval is that of its image times the number of places."""
    freqs = spectral.fft_scan(_images(spark, sf))
    power = F.aggregate(F.arrays_zip("re", "im"), F.lit(0.0), lambda a, s: a + s["re"] * s["re"] + s["im"] * s["im"])
    return _round(freqs.select("det_y", "det_x", (power / F.size("re")).alias("energy")), "energy", digits=0)


@query
def ifft_scan(spark, sf):
    back = spectral.ifft_scan(spectral.fft_scan(_images(spark, sf)))
    return _round(layout.images_to_rows(back).drop("dataset_id"), "value", digits=3)


def _strips(spark: SparkSession, sf: str) -> DataFrame:
    """Strips of a quarter of the scan's rows, so that every image lies in several tasks."""
    h, w = _size(spark, sf)
    return strips.row_strips(fx.frames(spark, sf), h, w, -(-h // 4))


@query
def fft_strips(spark, sf):
    """fft_scan's energies of images that are split into strips."""
    _, w = _size(spark, sf)
    power = strips.energy(strips.fft_strips(_strips(spark, sf), -(-w // 4))).join(fx.extents(fx.table(spark, sf, "embeddings"), "emb", 8, 8), "dataset_id")
    return _round(power.select("det_y", "det_x", (F.col("energy") / (F.col("scan_h") * F.col("scan_w"))).alias("energy")), "energy", digits=0)


@query
def ifft_strips(spark, sf):
    _, w = _size(spark, sf)
    back = strips.strip_rows(strips.ifft_strips(strips.fft_strips(_strips(spark, sf), -(-w // 4)), -(-w // 4)))
    return _round(back.select("det_y", "det_x", "y", "x", F.col("re").alias("value")), "value", digits=3)


@query
def correlate_strips(spark, sf):
    """cross_correlate by strips: the reference is smoothed by strips as well. Strips are read four times, so they are written;
    a task that reads them needs one Python worker where one that makes them needs another for each step."""
    some = scratch.kept(_strips(spark, sf), "strips")
    ref = strips.smooth_strips(some.where("det_y = 4 and det_x = 4"), 0.5, 4)
    return _round(strips.correlate_strips(some, ref, 4).drop("dataset_id"), "corr")


@query
def pixel_images(spark, sf):
    return layout.images_to_rows(_images(spark, sf))


@query
def dft_at(spark, sf):
    return _round(spectral.dft_at(fx.frames(spark, sf), 3, 5, *_size(spark, sf)), "re", "im", digits=4)


@query
def freq_roi_pattern(spark, sf):
    freqs = spectral.frequencies(spectral.fft_scan(_images(spark, sf)))
    return _round(spectral.freq_roi_pattern(freqs, (-1, 2), (0, 2), *_size(spark, sf)), "amplitude", "phase", digits=4)


@query
def spatial_freq_map(spark, sf):
    freqs = spectral.frequencies(spectral.fft_scan(_images(spark, sf)))
    return _round(spectral.spatial_freq_map(freqs), "value", "ln", digits=4)


@query
def amplitude_phase(spark, sf):
    freqs = spectral.frequencies(spectral.fft_scan(_images(spark, sf)))
    out = spectral.amplitude_phase(freqs).withColumn("phase", F.abs("phase"))  # real values have a phase of pi or -pi
    return _round(out, "amplitude", "phase", digits=3)


@query
def image_fft(spark, sf):
    out = spectral.image_fft(_context(spark, sf))
    return _round(out.drop("phase"), "re", "im", "magnitude", digits=4)


@query
def sampled_spectral_map(spark, sf):
    return _round(spectral.sampled_spectral_map(fx.frames(spark, sf), 25), "value", digits=4)


# --- super-resolution ------------------------------------------------------------------------------------------------


@query
def gaussian_smooth(spark, sf):
    return _round(layout.images_to_rows(align.gaussian_smooth(_images(spark, sf))), "value")


def _whole(spark: SparkSession, sf: str) -> dict:
    h, w = _size(spark, sf)
    return {"y1": 0, "y2": 8, "x1": 0, "x2": 8, "scan_h": h, "scan_w": w}


def _correlations(spark: SparkSession, sf: str) -> DataFrame:
    images = _images(spark, sf)
    return align.correlation_rows(align.cross_correlate(images, align.centre_reference(images)))


def _peaks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Correlations by row and their peaks, both written: lags aren't moved for the join with the few peaks, which goes by the
    size of their files."""
    rows = scratch.kept(_correlations(spark, sf), "correlations")
    return rows, scratch.kept(align.peak_argmax(rows), "peaks")


@query
def cross_correlate(spark, sf):
    return _round(_correlations(spark, sf).select("det_y", "det_x", "lag_y", "lag_x", "corr"), "corr")


@query
def peak_argmax(spark, sf):
    return _round(align.peak_argmax(_correlations(spark, sf)).select("det_y", "det_x", "peak_y", "peak_x", "peak"), "peak")


@query
def peak_neighbourhood(spark, sf):
    rows, peaks = _peaks(spark, sf)
    out = align.peak_neighbourhood(rows, peaks)
    return _round(out.select("det_y", "det_x", "up", "down", "left", "right"), "up", "down", "left", "right")


@query
def subpixel_quadratic(spark, sf):
    rows, peaks = _peaks(spark, sf)
    out = align.subpixel_quadratic(align.peak_neighbourhood(rows, peaks))
    return _round(out.select("det_y", "det_x", "shift_y", "shift_x", "quality"), "shift_y", "shift_x", "quality", digits=4)


@query
def subpixel_lstsq(spark, sf):
    rows, peaks = _peaks(spark, sf)
    out = align.subpixel_lstsq(align.peak_neighbourhood(rows, peaks, True))
    return _round(out.select("det_y", "det_x", "shift_y", "shift_x", "quality"), "shift_y", "shift_x", "quality", digits=4)


@query
def shift_maps(spark, sf):
    images = _images(spark, sf)
    out = align.shift_maps(images, align.centre_reference(images))
    return _round(out.select("det_y", "det_x", "shift_y", "shift_x", "quality"), "shift_y", "shift_x", "quality", digits=4)


@query
def center_shifts(spark, sf):
    return align.center_shifts(_shift_fixture(spark, sf), *_size(spark, sf)).select("det_y", "det_x", "shift_y", "shift_x")


@query
def center_shifts_on_pixel(spark, sf):
    return align.center_shifts_on_pixel(_shift_fixture(spark, sf)).select("det_y", "det_x", "shift_y", "shift_x")


@query
def fit_moments(spark, sf):
    shifts = align.center_shifts(_shift_fixture(spark, sf), *_size(spark, sf))
    out = align.fit_moments(shifts, 2, 4.0, 4.0, weight=F.col("quality")).drop("dataset_id")
    return _round(out, *out.columns)


@query
def fit_distortion(spark, sf):
    """A plane through the shifts by unweighted least squares, which SQL gives in closed form."""
    shifts = align.center_shifts(_shift_fixture(spark, sf), *_size(spark, sf))
    return _round(align.fit_distortion(shifts, 1, 3.5, 3.5).drop("dataset_id"), "coef_y", "coef_x", digits=8)


@query
def distortion_residuals(spark, sf):
    shifts = align.center_shifts(_shift_fixture(spark, sf), *_size(spark, sf))
    out = align.distortion_residuals(shifts, align.fit_distortion(shifts, 1, 3.5, 3.5), 1, 3.5, 3.5)
    return _round(out.select("det_y", "det_x", "ry", "rx"), "ry", "rx", digits=8)


@query
def fit_distortion_orders(spark, sf):
    """Fits of orders 1 to 5 on detectors of 64 x 64 and 256 x 256 pixels, weighted, without a constant: how far each is from
    the polynomial that the shifts are of, and what the fit gives."""
    out = None
    for size in (64, 256):
        for order in range(1, 6):
            shifts = fx.distorted(spark, sf, size, order)
            fit = align.fit_distortion(shifts, order, size // 2, size // 2, False, F.col("weight"), 2)
            left = align.distortion_residuals(shifts, fit, order, size // 2, size // 2, False)
            far = F.round(F.max(F.greatest(F.abs("ry"), F.abs("rx"))), 6)
            one = left.agg(F.count(F.lit(1)).alias("n"), (far + 0.0).alias("farthest"), F.round(F.sum(F.abs("fit_y")), 3).alias("sum_y"), F.round(F.sum(F.abs("fit_x")), 3).alias("sum_x"))
            one = one.select(F.lit(size).alias("size"), F.lit(order).alias("fit_order"), "*")
            out = one if out is None else out.unionByName(one)
    return out


@query
def best_order(spark, sf):
    """RMSE of the residuals for orders 1 to 4 of the fit."""
    shifts = scratch.kept(align.center_shifts(_shift_fixture(spark, sf), *_size(spark, sf)), "shifts")
    out = None
    for order in range(1, 5):
        left = align.distortion_residuals(shifts, align.fit_distortion(shifts, order, 4.0, 4.0), order, 4.0, 4.0)
        one = stats.residual_stats(left).select(F.lit(order).alias("fit_order"), "rmse_vector")
        out = one if out is None else out.unionByName(one)
    return _round(out, "rmse_vector", digits=4)


@query
def reconstruct_superres(spark, sf):
    out = align.reconstruct_superres(_images(spark, sf), _shift_fixture(spark, sf), 2, 4, 3, 0.3)
    return _round(out.drop("dataset_id"), "value")


@query
def contribution_map(spark, sf):
    return align.contribution_map(align.reconstruct_superres(_images(spark, sf), _shift_fixture(spark, sf), 2, 4, 3, 0.3)).drop("dataset_id")


def _centred(spark: SparkSession, sf: str) -> DataFrame:
    return align.center_shifts(_shift_fixture(spark, sf), *_size(spark, sf))


@query
def align_bilinear(spark, sf):
    return _round(align.align(_images(spark, sf), _centred(spark, sf), "bilinear").drop("dataset_id"), "value")


@query
def align_nearest(spark, sf):
    quarter = _centred(spark, sf).withColumns({"shift_y": F.col("shift_y") + 0.25, "shift_x": F.col("shift_x") + 0.25})
    return _round(align.align(_images(spark, sf), quarter, "nearest", sign=-1).drop("dataset_id"), "value")


@query
def align_bicubic(spark, sf):
    return _round(align.align(_images(spark, sf), _centred(spark, sf), "bicubic", 2).drop("dataset_id"), "value")


@query
def superres_pipeline(spark, sf):
    shifts, out = superres.superres(fx.frames(spark, sf), _whole(spark, sf), fac=2, pad=4, lims=3, threshold=0.01)
    return _round(out.drop("dataset_id"), "value", digits=4)


@query
def adf_pairwise(spark, sf):
    ring = select.annulus_mask(spark, 8, 8, 4, 4, 2, 3)
    _, out = superres.adf_pairwise(_images(spark, sf), ring, (4, 2), (4, 6), 2, 4, 0.01)
    return _round(out.drop("dataset_id"), "value", digits=4)


@query
def virtual_adf_reference(spark, sf):
    ring = select.annulus_mask(spark, 8, 8, 4, 4, 2, 3)
    out = superres.virtual_adf_reference(_images(spark, sf), ring)
    return out.select(F.posexplode("ref").alias("k", "value"))


# --- streams ---------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, rows: DataFrame, transform, mode: str = "append") -> DataFrame:
    """A table written as a few files, streamed file by file through a transformation into another table."""
    source, target = scratch.fresh(spark, "arriving"), scratch.fresh(spark, "live")
    rows.repartition(3).write.parquet(source)
    stream = transform(live.read_frames_stream(spark, source, rows.schema))
    q = live.run_to_table(stream, target, scratch.fresh(spark, "live-checkpoint"), mode)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@query
def read_frames_stream(spark, sf):
    return _streamed(spark, fx.frames(spark, sf), detect.scan_overview)


@query
def progressive_spectra(spark, sf):
    return layout.explode_voxels(_streamed(spark, fx.frames(spark, sf, "eels", 16, 4), live.progressive_spectra))


@query
def live_virtual_images(spark, sf):
    return _streamed(spark, fx.frames(spark, sf), lambda s: live.live_virtual_images(s, 4, 4, 1, 2, 3))


@query
def late_duplicate_frames(spark, sf):
    """Every event is sent twice; each frame stays once."""
    rows = fx.arrivals(spark, sf).select("dataset_id", "frame_idx", "ts")
    return _streamed(spark, rows.unionByName(rows), lambda s: live.first_arrivals(s, "3650 days")).select("dataset_id", "frame_idx")


def _two_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, list[Row]]:
    """A stream of first arrivals that stops after half of the events and goes on from its checkpoint when the rest is
    there: the table that both runs wrote, and the metrics after each run."""
    source, target, checkpoint = (scratch.fresh(spark, n) for n in ("arriving", "live", "live-checkpoint"))
    rows = fx.arrivals(spark, sf).select("dataset_id", "frame_idx", "ts")
    told, log = [], live.ProgressLog(spark, scratch.fresh(spark, "progress"))
    for half in (0, 1):
        rows.where(F.col("frame_idx") % 2 == half).coalesce(1).write.mode("append").parquet(source)
        stream = live.first_arrivals(live.read_frames_stream(spark, source, rows.schema), "3650 days")
        q = live.run_to_table(stream, target, checkpoint)
        q.awaitTermination()
        log.flush()
        told.append(live.progress_metrics(spark, log.path, rows.count()).select("batches", "rows", "percent").first())  # one query
    log.stop()
    return spark.read.schema(rows.schema).parquet(target), told


@query
def stop_resume(spark, sf):
    return _two_runs(spark, sf)[0].select("dataset_id", "frame_idx")


@query
def progress_metrics(spark, sf):
    told = _two_runs(spark, sf)[1]
    return spark.createDataFrame([(k + 1, m["rows"], m["percent"]) for k, m in enumerate(told)], "run int, rows long, percent double").transform(_round, "percent")


@query
def region_ready(spark, sf):
    """Regions of three rows and ten columns of the scan, before and after the second part of the frames arrives, over a restart."""
    source, target, checkpoint = (scratch.fresh(spark, n) for n in ("arriving", "live", "live-checkpoint"))
    rows = fx.arrivals(spark, sf).select(F.lit("all").alias("dataset_id"), "frame_idx")
    regions = spark.range(30).select(F.lit("all").alias("dataset_id"), F.col("id").alias("region"), F.lit(50).alias("scan_w"), *(F.expr(f"int({e})").alias(n) for n, e in (("y0", "id"), ("y1", "id + 3"), ("x0", "id"), ("x1", "id + 10"))))
    out = None
    for run in (1, 2):
        rows.where((F.col("frame_idx") % 201 < 150) == (run == 1)).repartition(2).write.mode("append").parquet(source)
        live.keep_masks(live.completion_masks(live.read_frames_stream(spark, source, rows.schema)), target, checkpoint).awaitTermination()
        one = scratch.kept(live.region_ready(live.current_masks(spark, target), regions), "ready").select(F.lit(run).alias("run"), "region", "ready")
        out = one if out is None else out.unionByName(one)
    return out


@query
def completion_state(spark, sf):
    """Counts of the bits of the last masks, from a stream in update mode."""
    source, target = scratch.fresh(spark, "arriving"), scratch.fresh(spark, "live")
    rows = fx.arrivals(spark, sf).select("dataset_id", "frame_idx")
    rows.unionByName(rows.where("frame_idx % 3 = 0")).repartition(3).write.parquet(source)
    live.keep_masks(live.completion_masks(live.read_frames_stream(spark, source, rows.schema)), target, scratch.fresh(spark, "live-checkpoint")).awaitTermination()
    return _round(live.completion_state(live.current_masks(spark, target), _arrival_sets(spark, sf)), "percent")
