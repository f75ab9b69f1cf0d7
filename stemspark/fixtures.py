"""Cubes that the driver's tables stand for, so that every operator has whole-number input of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import meta


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extents(rows: DataFrame, dataset_id: str, det_h: int, det_w: int) -> DataFrame:
    """The one row of `datasets` for an acquisition of which each row is a frame."""
    n = rows.agg(F.count(F.lit(1)).alias("n_frames")).withColumn("dataset_id", F.lit(dataset_id))
    out = meta.infer_scan_size(n).join(n, "dataset_id")
    return out.select("dataset_id", "n_frames", "scan_h", "scan_w", F.lit(det_h).alias("det_h"), F.lit(det_w).alias("det_w"))


def frames(spark: SparkSession, sf_dir: str, dataset_id: str = "emb", det_h: int = 8, det_w: int = 8) -> DataFrame:
    """Dense frames: the vectors of `embeddings` scaled to whole numbers."""
    rows = table(spark, sf_dir, "embeddings")
    size = extents(rows, dataset_id, det_h, det_w).select("dataset_id", "det_h", "det_w", "scan_w")
    counts = F.transform("embedding", lambda v: F.round((v.cast("double") + 1) * 1000).cast("int"))
    out = rows.select(F.col("vec_id").cast("long").alias("frame_idx"), counts.alias("counts")).crossJoin(F.broadcast(size))  # one row
    y, x = meta.frame_position(F.col("frame_idx"), F.col("scan_w"))
    return out.select("dataset_id", "frame_idx", y.alias("scan_y"), x.alias("scan_x"), "det_h", "det_w", "counts")


def eels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors on a rectangular detector: 16 energy channels."""
    return frames(spark, sf_dir, "eels", 4, 16)


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context image on the scan grid of frames()."""
    rows = table(spark, sf_dir, "embeddings")
    size = extents(rows, "emb", 8, 8).select("dataset_id", "scan_w")
    y, x = meta.frame_position(F.col("vec_id"), F.col("scan_w"))
    return rows.select("vec_id", "label").crossJoin(F.broadcast(size)).select("dataset_id", y.alias("scan_y"), x.alias("scan_x"), F.col("label").cast("int").alias("value"))


def damaged(frames_: DataFrame) -> DataFrame:
    """frames with a zero wherever (frame_idx * pixels + place) is a multiple of 97."""
    pixels = F.col("det_h") * F.col("det_w")
    counts = F.transform("counts", lambda c, k: F.when((F.col("frame_idx") * pixels + k) % 97 == 0, F.lit(0)).otherwise(c))
    return frames_.withColumn("counts", counts)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-mode voxels: orders are scan positions, parts fall on a 16 x 16 detector, quantities are counts."""
    items = table(spark, sf_dir, "lineitem")
    size = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n_frames")).withColumn("dataset_id", F.lit("events"))
    size = meta.infer_scan_size(size).select("dataset_id", "scan_h", "scan_w")
    hits = items.groupBy(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 256).alias("p")).agg(F.sum("l_quantity").cast("long").alias("count"))
    y, x = meta.frame_position(F.col("k"), F.col("scan_w"))
    return hits.crossJoin(F.broadcast(size)).select("dataset_id", y.alias("scan_y"), x.alias("scan_x"), F.expr("cast(p div 16 as int)").alias("det_y"), (F.col("p") % 16).cast("int").alias("det_x"), "count")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as they arrive: events of several data sets, each of which covers a part of the scan."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset_id"), F.col("event_id").cast("long").alias("frame_idx"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 16).cast("int").alias("channel"), F.round(F.col("value") * 100).cast("long").alias("count")
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of acquisitions of many shapes, from `part`."""
    p = table(spark, sf_dir, "part")
    h = F.pow(F.lit(2.0), 1 + F.col("p_size") % 9).cast("int")
    w = F.when(F.col("p_partkey") % 3 == 0, 4 * h).otherwise(h)
    out = p.select(F.col("p_partkey").cast("string").alias("dataset_id"), (F.col("p_partkey") + 1).cast("long").alias("n_frames"), h.alias("det_h"), w.cast("int").alias("det_w"))
    return out.withColumn("file_size", F.col("n_frames") * (384 + 2 * F.col("det_h").cast("long") * F.col("det_w")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Super-resolution runs of data sets and how far they came, from `orders`."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("run_id"), F.col("o_custkey").cast("long").alias("dataset_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("step_completed")
    )


def distorted(spark: SparkSession, sf_dir: str, size: int, order: int) -> DataFrame:
    """Shifts on a detector of size x size pixels that follow a polynomial of that order, of a few pixels: places and weights
    from `lineitem`."""
    items = table(spark, sf_dir, "lineitem")
    at = items.groupBy((F.col("l_orderkey") % size).cast("int").alias("det_y"), ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % size).cast("int").alias("det_x")).agg(F.sum("l_quantity").alias("weight"))
    u, v = (F.col("det_y") - size // 2) / (size // 2), (F.col("det_x") - size // 2) / (size // 2)
    y, x = 2 * u - v, v - u / 2
    for degree in range(2, order + 1):
        y, x = y + F.pow(u, F.lit(degree - 1)) * v * 3 / degree, x - F.pow(v, F.lit(degree)) * 2 / degree
    return at.select(F.lit(f"{size}").alias("dataset_id"), "det_y", "det_x", y.alias("shift_y"), x.alias("shift_x"), "weight")
