"""Masks as table functions, for queries that are SQL text alone."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_PIXEL = "det_y int, det_x int"


def _rows(h: int, w: int, cy: float, cx: float, lo: float, hi: float) -> Iterator[tuple[int, int]]:
    """Pixels whose squared distance from the centre lies between two squares, row by row."""
    for y in range(h):
        for x in range(w):
            if lo <= (y - cy) ** 2 + (x - cx) ** 2 <= hi:
                yield y, x


class DiskMask:
    def eval(self, h: int, w: int, cy: float, cx: float, r: float) -> Iterator[tuple[int, int]]:
        if None not in (h, w, cy, cx, r):
            yield from _rows(h, w, float(cy), float(cx), 0.0, float(r) ** 2)


class AnnulusMask:
    def eval(self, h: int, w: int, cy: float, cx: float, inner: float, outer: float) -> Iterator[tuple[int, int]]:
        if None not in (h, w, cy, cx, inner, outer):
            yield from _rows(h, w, float(cy), float(cx), float(inner) ** 2, float(outer) ** 2)


def register(spark: SparkSession) -> None:
    """disk_mask(h, w, cy, cx, r) and annulus_mask(h, w, cy, cx, inner, outer) in the session's SQL: det_y, det_x of the pixels of a
    detector of h x w, edges included; a null argument gives no pixel."""
    for name, kind in (("disk_mask", DiskMask), ("annulus_mask", AnnulusMask)):
        spark.udtf.register(name, udtf(kind, returnType=_PIXEL))
