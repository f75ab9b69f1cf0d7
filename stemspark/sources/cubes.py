"""Reading and writing cubes, images, spectra and results as tables."""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import explode_voxels
from . import footers, mib, tiles

_IMAGE = "dataset_id string, y int, x int, value double, metadata string"


def _ndata_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                image = np.load(io.BytesIO(z.read("data.npy")), allow_pickle=False)
                told = json.dumps(json.loads(z.read("metadata.json"))) if "metadata.json" in z.namelist() else None
            if image.ndim != 2:
                raise ValueError(f"{path} holds {image.ndim} axes, not an image")
            y, x = np.divmod(np.arange(image.size), image.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([mib.dataset_name(path)] * image.size), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(image.astype(float).ravel()), pa.array([told] * image.size, pa.string())],
                names=["dataset_id", "y", "x", "value", "metadata"],
            )


def read_ndata(spark: SparkSession, path: str) -> DataFrame:
    """Context images: zip files with data.npy (two axes) and metadata.json."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_ndata_task, _IMAGE)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """frames of a cube: detector files by their ending, else Parquet in this library's layout."""
    if path.lower().rstrip("/").endswith(".mib"):
        mib.register(spark)
        return spark.read.format("mib").load(path)
    return spark.read.parquet(path)


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row a detector file: extents, type and whether it can be read, without its pixels."""
    mib.register(spark)
    rows = spark.read.format("mib").option("mode", "header").load(path)
    kind = F.when(~F.col("compatible"), F.lit(None)).when(F.col("det_h") != F.col("det_w"), "EELS").otherwise("4D_STEM")
    return rows.withColumn("experiment_type", kind)


def write_cube(frames: DataFrame, path: str, codec: str = "zstd", mode: str = "overwrite") -> None:
    """frames as Parquet, a folder for each data set, in acquisition order inside files. Only data sets that are written are replaced."""
    rows = frames.sortWithinPartitions("dataset_id", "frame_idx")
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy("dataset_id").parquet(path)


def write_spectra(frames: DataFrame, path: str, energy_start: float = 0.0, energy_step: float = 1.0, source: str | None = None) -> None:
    """Spectra (frames with one detector row) with their energy axis and where they come from; refuses other frames."""
    one = F.when(F.col("det_h") == 1, F.col("counts")).otherwise(F.raise_error(F.lit("spectra have one detector row")))
    axis = F.transform(F.sequence(F.lit(0), F.col("det_w") - 1), lambda k: energy_start + energy_step * k)
    rows = frames.select("dataset_id", "frame_idx", "scan_y", "scan_x", F.transform(one, lambda c: c.cast("float")).alias("spectrum"), axis.alias("energy"), F.lit(source).cast("string").alias("source"), F.lit(True).alias("energy_flipped"))
    rows.write.mode("overwrite").parquet(path)


def verify_written(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Frames found of each data set against the n_frames, det_h and det_w that are expected."""
    found = spark.read.parquet(path).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("found"), F.min(F.size("counts")).alias("least"), F.max(F.size("counts")).alias("most"))
    out = expected.join(found, "dataset_id", "left")
    n = F.col("det_h") * F.col("det_w")
    good = F.col("found").eqNullSafe(F.col("n_frames")) & F.col("least").eqNullSafe(n) & F.col("most").eqNullSafe(n)
    return out.select("dataset_id", "n_frames", F.coalesce("found", F.lit(0).cast("long")).alias("found"), good.alias("ok"))


def _spread(column: Column) -> Column:
    """Sixteen bits with three free ones before each."""
    x = column.cast("long")
    for shift, mask in ((24, 0x000000FF000000FF), (12, 0x000F000F000F000F), (6, 0x0303030303030303), (3, 0x1111111111111111)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(columns: dict[str, int]) -> Column:
    """The place of up to four columns (name: greatest value, below 32768) on a space-filling curve: their bits in turn, the
    highest first, each axis stretched to the same length."""
    out = F.lit(0).cast("long")
    for k, (name, most) in enumerate(columns.items()):
        out = out.bitwiseOR(F.shiftleft(_spread(F.shiftleft(F.col(name), 14 - max(0, int(most).bit_length() - 1))), 3 - k))
    return out


def clustered(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows dealt and sorted along the curve over some columns of whole numbers, so that boxes in all of them are few runs."""
    most = rows.agg(*(F.max(n).alias(n) for n in names)).first()
    at = morton({n: most[n] or 0 for n in names})
    return rows.withColumn("_at", at).repartitionByRange("_at").sortWithinPartitions("_at").drop("_at")


def write_fft_result(freqs: DataFrame, path: str, mode_name: str, group_bytes: int = 8 << 20) -> None:
    """A transform under (dataset_id, mode); one that is there for the same data set and mode is replaced. Rows follow a curve
    over frequency and detector, so that a slice in these four skips most row groups (of about group_bytes)."""
    rows = clustered(freqs, ("ky", "kx", "det_y", "det_x")).withColumn("mode", F.lit(mode_name))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", group_bytes).partitionBy("dataset_id", "mode").parquet(path)


def read_cached_result(spark: SparkSession, path: str, *where) -> DataFrame:
    """A stored result, cut by predicates that reach its partitions and row groups."""
    out = spark.read.parquet(path)
    for condition in where:
        out = out.where(condition)
    return out


def structure_inventory(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """For each table (name to path): a row a column with its type, the table's rows, files and bytes."""
    out = None
    for name, path in tables.items():
        df = spark.read.parquet(path)
        files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).groupBy("f").agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("n"))
        size = files.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sum("s").alias("bytes"))
        columns = F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema))).alias("c")
        rows = size.select(F.lit(name).alias("table"), F.lit(path).alias("path"), "n_rows", "n_files", "bytes", columns).select("table", "path", "n_rows", "n_files", "bytes", "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def structure_statistics(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """For each table and column: table, column, n_rows, n_values, nulls, lo and hi from the footers alone, and mean and sd of
    numbers (of the items of lists) from moments that tasks merge."""
    out = None
    for name, path in tables.items():
        told = footers.column_ranges(footers.row_groups(spark, path)).select("column", "n_rows", "n_values", "nulls", "lo", "hi")
        sums = footers.merge_moments(footers.column_moments(spark.read.parquet(path))).drop("n")
        rows = told.join(sums, "column", "left").select(F.lit(name).alias("table"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def export_structure(inventory: DataFrame, path: str) -> None:
    inventory.write.mode("overwrite").json(path)


def _file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the data files under a path, as the file system tells them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def codec_study(frames: DataFrame, folder: str, codecs: tuple[str, ...] = ("none", "snappy", "gzip", "zstd", "lz4_raw"), budget: int = tiles.BUDGET) -> DataFrame:
    """One cube as Parquet in every layout by every codec: codec, layout, size_bytes, raw_bytes, ratio, write_s, and for
    each of three reads (one frame, the image of one detector pixel, a region of a quarter of the scan) the seconds that it took
    and the sum that it found: frame_s, frame_sum, pixel_s, pixel_sum, region_s, region_sum.

    Layouts are frames, voxels, and tiles of the shapes that `budget` gives for each pattern of reads. Tiles of a shape are made
    once, on the executors' disks, for all codecs: write_s is that of sorting and writing them. Frames that come in fewer
    partitions than there are cores are dealt by place over all of them before voxels or tiles are made."""
    spark = frames.sparkSession
    size = frames.agg(F.sum(2 * F.size("counts")).alias("raw"), *((F.max(c) + 1).alias(c) for c in ("scan_y", "scan_x")), F.max("det_h").alias("det_h"), F.max("det_w").alias("det_w")).first()
    if not size.raw:
        return spark.createDataFrame([], _STUDY)
    extents = (size.scan_y, size.scan_x, size.det_h, size.det_w)
    h, w, dh, dw = extents
    reads = {"frame": ((0, 1, 0, 1), None), "pixel": (None, (dh // 2, dh // 2 + 1, dw // 2, dw // 2 + 1)), "region": ((0, -(-h // 2), 0, -(-w // 2)), None)}
    cores, dealt = spark.sparkContext.defaultParallelism, frames
    if frames.rdd.getNumPartitions() < cores:
        dealt = frames.repartitionByRange(cores, "dataset_id", "scan_y", "scan_x")
    dealt = dealt.persist(StorageLevel.DISK_ONLY)
    rows = []
    for layout in ("frame", "voxel", *(f"tile_{p}" for p in tiles.PATTERNS)):
        if layout.startswith("tile_"):
            made = tiles.to_tiles(dealt, tiles.tile_shape(extents, layout.removeprefix("tile_"), budget)).persist(StorageLevel.DISK_ONLY)
            made.count()
            table = tiles.in_order(made)
        else:
            made, table = None, frames if layout == "frame" else explode_voxels(dealt)
        for codec in codecs:
            path, began = f"{folder}/{layout}-{codec}", time.time()
            table.write.mode("overwrite").option("compression", codec).parquet(path)
            found = [time.time() - began]
            for scan, det in reads.values():
                began = time.time()
                got = tiles.read_tiles(spark, path, None, scan, det) if made is not None else _some_voxels(spark.read.parquet(path), layout, scan, det)
                total = got.agg(F.sum("count")).first()[0]
                found += [time.time() - began, int(total or 0)]
            bytes_ = _file_bytes(spark, path)
            rows.append((codec, layout, bytes_, size.raw, size.raw / bytes_, *found))
        if made is not None:
            made.unpersist()
    dealt.unpersist()
    return spark.createDataFrame(rows, _STUDY)


_STUDY = "codec string, layout string, size_bytes long, raw_bytes long, ratio double, write_s double, frame_s double, frame_sum long, pixel_s double, pixel_sum long, region_s double, region_sum long"


def _some_voxels(table: DataFrame, layout: str, scan: tuple | None, det: tuple | None) -> DataFrame:
    """Voxels in boxes as tiles.read_tiles takes them, from frames or voxels."""
    if scan:
        table = table.where((F.col("scan_y") >= scan[0]) & (F.col("scan_y") < scan[1]) & (F.col("scan_x") >= scan[2]) & (F.col("scan_x") < scan[3]))
    table = explode_voxels(table) if layout == "frame" else table
    if det:
        table = table.where((F.col("det_y") >= det[0]) & (F.col("det_y") < det[1]) & (F.col("det_x") >= det[2]) & (F.col("det_x") < det[3]))
    return table
