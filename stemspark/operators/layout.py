"""Frames, voxels and pixel images: three layouts of one cube, and sparse forms of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..schemas import PIXEL_IMAGES
from .dense import scattered
from .meta import frame_position


def explode_voxels(frames: DataFrame) -> DataFrame:
    """One row per scan position and detector pixel."""
    out = frames.select("dataset_id", "scan_y", "scan_x", "det_w", F.posexplode("counts").alias("pos", "count"))
    return out.select("dataset_id", "scan_y", "scan_x", F.expr("cast(pos div det_w as int)").alias("det_y"), (F.col("pos") % F.col("det_w")).cast("int").alias("det_x"), "count")


def frames_from_voxels(voxels: DataFrame, det_h: int, det_w: int, scan_w: int) -> DataFrame:
    """Frames in acquisition order of their pixels; pixels without a row are 0."""
    at = F.col("det_y") * det_w + F.col("det_x")
    grouped = voxels.groupBy("dataset_id", "scan_y", "scan_x").agg(F.collect_list(F.struct(at.alias("k"), F.col("count").alias("v"))).alias("p"))
    dense = scattered(grouped, F.lit(det_h * det_w), F.col("p.k"), F.col("p.v"))
    index = F.col("scan_y").cast("long") * scan_w + F.col("scan_x")
    return dense.select("dataset_id", index.alias("frame_idx"), "scan_y", "scan_x", F.lit(det_h).alias("det_h"), F.lit(det_w).alias("det_w"), F.col("dense").alias("counts"))


def frame_order(frames: DataFrame, scan_w: int) -> DataFrame:
    """frames with their scan position computed from frame_idx."""
    y, x = frame_position(F.col("frame_idx"), F.lit(scan_w))
    return frames.withColumns({"scan_y": y, "scan_x": x})


def detector_pixel_image(frames: DataFrame, det_y: int, det_x: int) -> DataFrame:
    """The scan image of one detector pixel, without exploding frames."""
    return frames.select("dataset_id", "scan_y", "scan_x", F.get("counts", det_y * F.col("det_w") + det_x).alias("value"))


def standard_bf(frames: DataFrame) -> DataFrame:
    """The scan image of the detector's centre pixel."""
    at = F.expr("(det_h div 2) * det_w + det_w div 2").cast("int")
    return frames.select("dataset_id", "scan_y", "scan_x", F.get("counts", at).alias("value"))


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds all of them; others as they are."""
    if values.dtype.kind not in "iu" or not values.size:
        return values
    return values.astype(np.promote_types(np.min_scalar_type(values.min()), np.min_scalar_type(values.max())))


_TILES = pa.schema(
    [("dataset_id", pa.string()), ("part", pa.int32()), ("n", pa.int32()), ("first", pa.int32()), ("det_w", pa.int32()), ("start", pa.int64()), ("count", pa.int32()), ("frames", pa.binary()), ("kind", pa.string()), ("tile", pa.binary())]
)


def _tile_task(block: int) -> Callable:
    """Frames to tiles: for each block of detector pixels, the places and values of a batch's frames.

    Counts go in the smallest type that holds them, consecutive frames as the first and their number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            frame, width = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            for id_ in dict.fromkeys(ids.tolist()):
                which = np.flatnonzero(ids == id_)
                some = lists if len(which) == len(ids) else lists.take(pa.array(which))
                values = _narrow(some.flatten().to_numpy(zero_copy_only=False)).reshape(len(which), -1)
                at = frame[which]
                row = bool((np.diff(at) == 1).all())
                places = None if row else at.astype("<i8").tobytes()
                rows = []
                for k, lo in enumerate(range(0, values.shape[1], block)):
                    tile = np.ascontiguousarray(values[:, lo : lo + block].T)
                    rows.append((id_, k, tile.shape[0], lo, int(width[which[0]]), int(at[0]), len(at), places, tile.dtype.str, tile.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TILES, strict=True)], schema=_TILES)

    return task


def _join_task(scan_h: int, scan_w: int) -> Callable:
    def task(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        n = rows[0]["n"]
        image = np.zeros((n, scan_h * scan_w))
        for r in rows:
            tile = np.frombuffer(r["tile"], r["kind"]).reshape(n, -1)
            if r["frames"] is None:
                lo, hi = max(0, r["start"]), min(scan_h * scan_w, r["start"] + r["count"])
                if lo < hi:
                    image[:, lo:hi] = tile[:, lo - r["start"] : hi - r["start"]]
            else:
                at = np.frombuffer(r["frames"], "<i8")
                inside = (at >= 0) & (at < scan_h * scan_w)
                image[:, at[inside]] = tile[:, inside]
        pixel = np.arange(rows[0]["first"], rows[0]["first"] + n)
        width = rows[0]["det_w"]
        offsets = pa.array(np.arange(n + 1) * scan_h * scan_w, pa.int32())
        return pa.table(
            {
                "dataset_id": pa.array([rows[0]["dataset_id"]] * n, pa.string()),
                "det_y": pa.array(pixel // width, pa.int32()),
                "det_x": pa.array(pixel % width, pa.int32()),
                "scan_h": pa.array([scan_h] * n, pa.int32()),
                "scan_w": pa.array([scan_w] * n, pa.int32()),
                "img": pa.ListArray.from_arrays(offsets, pa.array(image.ravel())),
            }
        )

    return task


def pixel_images(frames: DataFrame, scan_h: int, scan_w: int, block: int = 0) -> DataFrame:
    """The transposed layout: one scan image per detector pixel; positions without a frame are 0.

    Tiles of (detector pixels x frames) are shuffled, not voxels, with counts in one or two bytes where they fit. A task holds the images of one block of detector
    pixels, `block` x scan positions x 8 bytes: 32 MB by default, and one image must fit in a task.
    """
    block = block or max(1, (4 << 20) // max(1, scan_h * scan_w))
    rows = frames.select("dataset_id", "frame_idx", "det_w", "counts")
    tiles = rows.mapInArrow(_tile_task(block), "dataset_id string, part int, n int, first int, det_w int, start long, count int, frames binary, kind string, tile binary")
    return tiles.groupBy("dataset_id", "part").applyInArrow(_join_task(scan_h, scan_w), PIXEL_IMAGES)


def images_to_rows(images: DataFrame) -> DataFrame:
    """dataset_id, det_y, det_x, y, x, value of pixel images."""
    out = images.select("dataset_id", "det_y", "det_x", "scan_w", F.posexplode("img").alias("k", "value"))
    return out.select("dataset_id", "det_y", "det_x", F.expr("cast(k div scan_w as int)").alias("y"), (F.col("k") % F.col("scan_w")).cast("int").alias("x"), "value")


def sparse_frames(frames: DataFrame) -> DataFrame:
    """Frames as places and values of the pixels that aren't 0."""
    pairs = F.filter(F.transform("counts", lambda c, k: F.struct(k.cast("int").alias("idx"), c.alias("val"))), lambda s: s["val"] != 0)
    both = let(pairs, lambda p: F.struct(F.transform(p, lambda s: s["idx"]).alias("idx"), F.transform(p, lambda s: s["val"]).alias("val")))
    return frames.select("dataset_id", "frame_idx", "scan_y", "scan_x", "det_h", "det_w", both.alias("p")).select("dataset_id", "frame_idx", "scan_y", "scan_x", "det_h", "det_w", "p.idx", "p.val")


def frames_from_sparse(sparse: DataFrame) -> DataFrame:
    """The inverse of sparse_frames."""
    item = sparse.schema["val"].dataType.elementType.simpleString()
    return scattered(sparse, F.col("det_h") * F.col("det_w"), F.col("idx"), F.col("val"), item).withColumnRenamed("dense", "counts").drop("idx", "val")


def saturated(count: Column) -> Column:
    """A count in eight bits, where 255 stands for more."""
    return F.least(count, F.lit(255))


def overflow_encoding(voxels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Voxels in eight bits (`u8` is 255 where the count is 255 or more), and the side table of those counts."""
    small = voxels.select("dataset_id", "scan_y", "scan_x", "det_y", "det_x", F.when(F.col("count") >= 255, 255).otherwise(F.least("count", F.lit(254))).cast("int").alias("u8"))
    return small, voxels.where("count >= 255").select("dataset_id", "scan_y", "scan_x", "det_y", "det_x", "count")


def overflow_summary(voxels: DataFrame) -> DataFrame:
    """Share of voxels in the side table, and bytes by which two-byte voxels shrink (13 bytes an entry there)."""
    n, over = F.count(F.lit(1)), F.count_if(F.col("count") >= 255)
    return voxels.groupBy("dataset_id").agg(n.alias("n"), over.alias("overflow"), F.round(over / n, 6).alias("share"), F.round(2 * n / (n + 13 * over), 6).alias("ratio"))
