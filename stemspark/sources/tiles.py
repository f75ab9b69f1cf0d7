"""Cubes as tables of tiles: each row is a block of scan positions x detector pixels, its counts packed in the smallest type.

A tile's shape is chosen by a budget of bytes and by what is read most: whole frames, images of detector pixels, or both.
Tiles are sorted by their places, so a read of some scan positions and some detector pixels skips the row groups and
unpacks only the tiles that hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dense import matrices
from ..schemas import VOXELS

BUDGET = 1 << 20
PATTERNS = ("frame", "pixel", "balanced")
AXES = ("scan_y", "scan_x", "det_y", "det_x")
#: One row a tile: where it begins on each axis and how far it reaches, the type of its counts, and these in C order.
TILES = "dataset_id string, " + ", ".join(f"{a}0 int" for a in AXES) + ", " + ", ".join(f"{a}n int" for a in AXES) + ", kind string, data binary"

Extents = tuple[int, int, int, int]


def tile_shape(extents: Extents, pattern: str = "balanced", budget: int = BUDGET, item: int = 2) -> Extents:
    """Extents of a tile of at most `budget` bytes: the scan axes are halved first for frames, the detector's first for
    images of pixels, the longest axis for both."""
    if pattern not in PATTERNS:
        raise ValueError(f"{pattern} is none of {PATTERNS}")
    shape = list(extents)
    while np.prod(shape) * item > budget and max(shape) > 1:
        first = {"frame": shape[:2], "pixel": shape[2:], "balanced": shape}[pattern]
        among = first if max(first) > 1 else shape
        k = shape.index(max(among), 2 if among is first and pattern == "pixel" else 0)
        shape[k] = -(-shape[k] // 2)
    return tuple(shape)


def _narrowest(values: np.ndarray) -> np.dtype:
    return np.promote_types(np.min_scalar_type(values.min()), np.min_scalar_type(values.max()))


def _part_task(shape: Extents) -> Callable:
    """Frames to parts of tiles: places in the tile's scan block, and values of its detector block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            y, x, h, w = (batch.column(k).to_numpy() for k in range(1, 5))
            ty, tx = y // shape[0] * shape[0], x // shape[1] * shape[1]
            rows = []
            for key in dict.fromkeys(zip(ids.tolist(), ty.tolist(), tx.tolist(), h.tolist(), w.tolist(), strict=True)):
                id_, y0, x0, dh, dw = key
                which = np.flatnonzero((ids == id_) & (ty == y0) & (tx == x0) & (h == dh) & (w == dw))
                values = matrices(batch.column(5).take(pa.array(which))).reshape(-1, dh, dw)
                places = np.stack([y[which] - y0, x[which] - x0], 1).astype("<i4").tobytes()
                for v0 in range(0, dh, shape[2]):
                    for u0 in range(0, dw, shape[3]):
                        part = values[:, v0 : v0 + shape[2], u0 : u0 + shape[3]]
                        kind = _narrowest(part)
                        rows.append((id_, y0, x0, v0, u0, *part.shape[1:], places, kind.str, part.astype(kind).tobytes()))
            kinds = [pa.string(), *[pa.int32()] * 6, pa.binary(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["dataset_id", *(f"{a}0" for a in AXES), "vn", "un", "places", "kind", "part"])

    return task


def to_tiles(frames: DataFrame, shape: Extents) -> DataFrame:
    """frames as TILES of a shape; positions without a frame inside a tile are 0, of equal ones the last counts. Parts of
    tiles are shuffled, not voxels, and a task holds one tile at a time."""

    def join(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = rows[0]
        at = [np.frombuffer(r["places"], "<i4").reshape(-1, 2) for r in rows]
        parts = [np.frombuffer(r["part"], r["kind"]).reshape(len(a), first["vn"], first["un"]) for r, a in zip(rows, at, strict=True)]
        values = np.concatenate(parts)
        place = np.concatenate(at)
        tile = np.zeros((*(place.max(0) + 1), first["vn"], first["un"]), np.promote_types(values.dtype, np.uint8))
        tile[place[:, 0], place[:, 1]] = values
        kind = _narrowest(tile)
        out = [first["dataset_id"], *(first[f"{a}0"] for a in AXES), *tile.shape, kind.str, tile.astype(kind).tobytes()]
        kinds = [pa.string(), *[pa.int32()] * 8, pa.string(), pa.binary()]
        return pa.table({n: pa.array([v], t) for n, v, t in zip([c.split()[0] for c in TILES.split(", ")], out, kinds, strict=True)})

    rows = frames.select("dataset_id", "scan_y", "scan_x", "det_h", "det_w", "counts")
    parts = rows.mapInArrow(_part_task(shape), "dataset_id string, " + ", ".join(f"{a}0 int" for a in AXES) + ", vn int, un int, places binary, kind string, part binary")
    return parts.groupBy("dataset_id", *(f"{a}0" for a in AXES)).applyInArrow(join, TILES)


def in_order(tiles: DataFrame) -> DataFrame:
    """Tiles sorted by data set and place over the whole table."""
    by = ["dataset_id", *(f"{a}0" for a in AXES)]
    return tiles.repartitionByRange(*by).sortWithinPartitions(*by)


def write_tiles(frames: DataFrame, path: str, shape: Extents, codec: str = "zstd") -> None:
    """Tiles as Parquet, in order."""
    in_order(to_tiles(frames, shape)).write.mode("overwrite").option("compression", codec).parquet(path)


def read_tiles(spark: SparkSession, path: str, dataset_id: str | None = None, scan: Extents | None = None, det: Extents | None = None) -> DataFrame:
    """Voxels of the scan positions and detector pixels in boxes (first and last y, first and last x, ends excluded). The
    boxes reach the scan of the table as filters on where tiles begin and end."""
    tiles = spark.read.parquet(path)
    tiles = tiles.where(F.col("dataset_id") == dataset_id) if dataset_id is not None else tiles
    box: dict[str, tuple[int, int]] = {}
    for names, limits in ((AXES[:2], scan), (AXES[2:], det)):
        box |= {a: limits[2 * k : 2 * k + 2] for k, a in enumerate(names if limits else ())}
    longest = spark.read.parquet(path).agg(*(F.max(f"{a}n").alias(a) for a in box)).first() if box else {}
    for a, (lo, hi) in box.items():
        tiles = tiles.where((F.col(f"{a}0") < hi) & (F.col(f"{a}0") > lo - (longest[a] or 0)) & (F.col(f"{a}0") + F.col(f"{a}n") > lo))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                tile = np.frombuffer(row["data"], row["kind"]).reshape([row[f"{a}n"] for a in AXES])
                base = [row[f"{a}0"] for a in AXES]
                cut = [slice(*(min(max(v - b, 0), n) for v in box.get(a, (b, b + n)))) for a, b, n in zip(AXES, base, tile.shape, strict=True)]
                some = tile[tuple(cut)]
                places = [(g.ravel() + c.start + b).astype(np.int32) for g, c, b in zip(np.indices(some.shape), cut, base, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["dataset_id"]] * some.size, pa.string()), *map(pa.array, places), pa.array(some.ravel().astype(np.int64))], names=["dataset_id", *AXES, "count"])

    return tiles.mapInArrow(task, VOXELS)
