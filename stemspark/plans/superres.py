"""Super-resolution in five steps, from frames to an image on a finer grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, geometry, layout, select
from ..sources.scratch import kept
from .runs import RunStore


def detect(frames: DataFrame, fraction: float = 0.1) -> dict:
    """Centre and radius of the bright-field disk, and a square crop about it: a few numbers on the driver."""
    size = frames.agg(F.max("det_h").alias("h"), F.max("det_w").alias("w"), (F.max("scan_y") + 1).alias("sh"), (F.max("scan_x") + 1).alias("sw")).first()
    c = geometry.bf_center_com(frames, fraction).first()
    profile = geometry.radial_profile(geometry.pattern_of(frames), c.cy, c.cx)
    found = geometry.bf_radius(profile).first()
    radius = int(found.radius) if found is not None and found.radius else min(size.h, size.w) // 8
    y1, y2, x1, x2 = select.crop_bounds(c.cy, c.cx, max(1, radius), size.h, size.w)
    return {"cy": c.cy, "cx": c.cx, "radius": radius, "y1": y1, "y2": y2, "x1": x1, "x2": x2, "scan_h": size.sh, "scan_w": size.sw}


def superres(frames: DataFrame, crop: dict | None = None, sigma: float = 0.5, fac: int = 4, pad: int = 16, lims: int = 16, threshold: float = 0.8, store: RunStore | None = None, run_id: str = "run") -> tuple[DataFrame, DataFrame]:
    """Shift map and reconstruction of one data set. With a store, the images, shifts and result are its stage tables.

    Images, reference and shifts are written in either case: the next steps read them more than once, and joins go by
    the sizes of the written tables."""
    crop = crop or detect(frames)
    cut = select.crop_detector(frames, crop["y1"], crop["y2"], crop["x1"], crop["x2"])
    images = layout.pixel_images(cut, crop["scan_h"], crop["scan_w"])
    params = {k: str(v) for k, v in crop.items()} | {"sigma": str(sigma), "fac": str(fac)}
    dataset = ""
    if store:
        dataset = frames.select("dataset_id").first()[0]
        store.start(run_id, dataset, params)
        images = store.write_stage(run_id, dataset, 2, images, params)
    else:
        images = kept(images, "images")
    middle = (crop["y2"] - crop["y1"]) // 2, (crop["x2"] - crop["x1"]) // 2
    reference = kept(align.centre_reference(images, sigma, middle), "reference")
    shifts = align.shift_maps(images, reference)
    shifts = store.write_stage(run_id, dataset, 4, shifts, params) if store else kept(shifts, "shifts")
    out = align.reconstruct_superres(images, shifts, fac, pad, lims, threshold)
    if store:
        out = store.write_stage(run_id, dataset, 5, out, params)
    return shifts, out


def virtual_adf_reference(images: DataFrame, mask: DataFrame) -> DataFrame:
    """dataset_id, ref: the sum of the images of a mask's pixels."""
    some = images.join(mask, ["det_y", "det_x"], "left_semi").select("dataset_id", F.posexplode("img").alias("k", "v"))
    total = some.groupBy("dataset_id", "k").agg(F.sum("v").alias("v"))
    return total.groupBy("dataset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("ref"))


def pair_reference(images: DataFrame, a: tuple[int, int], b: tuple[int, int], damping: float = 0.5) -> DataFrame:
    """dataset_id, ref: the mean of two opposing pixels' images, each moved by a share of the shift between them."""
    at = lambda p: images.where((F.col("det_y") == p[0]) & (F.col("det_x") == p[1]))
    size = images.groupBy("dataset_id").agg(F.max("scan_h").alias("h"), F.max("scan_w").alias("w"))
    between = align.shift_maps(at(b), at(a).select("dataset_id", F.col("img").alias("ref"))).join(size, "dataset_id")
    dy, dx = F.col("shift_y") - F.floor(F.col("h") / 2), F.col("shift_x") - F.floor(F.col("w") / 2)
    half = [between.select("dataset_id", F.lit(p[0]).alias("det_y"), F.lit(p[1]).alias("det_x"), (s * damping * dy).alias("shift_y"), (s * damping * dx).alias("shift_x")) for p, s in ((a, -1), (b, 1))]
    both = at(a).unionByName(at(b))
    moved = align.align(both, half[0].unionByName(half[1]), "bilinear")
    order = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    return moved.groupBy("dataset_id").agg(F.transform(order, lambda s: s["value"]).alias("ref"))


def adf_pairwise(images: DataFrame, mask: DataFrame, a: tuple[int, int], b: tuple[int, int], fac: int = 4, pad: int = 16, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Reconstruction from an annulus, which has no sharp image of its own: a pair of opposing pixels gives the reference."""
    some = images.join(mask, ["det_y", "det_x"], "left_semi")
    shifts = align.shift_maps(some, pair_reference(images, a, b))
    return shifts, align.reconstruct_superres(some, shifts, fac, pad, 1 << 20, threshold)
