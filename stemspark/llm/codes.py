"""Vector codes of a product quantiser, fitted by Lloyd rounds over cover trees.

A vector is cut into PARTS equal parts, and each part position has a codebook of ENTRIES entries. Blocks of vectors get
one cover tree a part position: the children of a node are centres more than half its scale apart that cover its points,
and points stand in the order of the tree, so that a node is a range of them and its sum a difference of cumulative sums.
In a round a node looks at the entries that its parent couldn't rule out. By the triangle inequality an
entry that is further from the centre than the nearest one by more than twice the node's radius is nearest to none of its
points; if one entry stays, the whole subtree goes to it. Only other nodes are descended, down to exact comparisons
of integers at single points.

Trees are built once and written in the shared folder; a round sends the codebooks to the tasks (PARTS x ENTRIES entries,
whatever the table's size) and brings back their sums. A block has at most BLOCK vectors, so memory is bounded, and equal
parts of a block are one point with a weight.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped; all other vectors
must have one length that PARTS divides, and components below LIMIT after scaling, else the job is refused; null ids are
the largest, equal ids go by their vectors; each repeated row is coded and counted by itself; with fewer than ENTRIES rows
there are as many entries; null labels are one label; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import spread_join
from .store import Scratch, kept, long_id

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of one block of trees.
BLOCK = 4096
#: Scaled components lie within this, so that squared distances and sums are exact in 64 bits.
LIMIT = 1 << 28

CODES = "vec_id long, label string, code string, error long"


class Tree(NamedTuple):
    """Distinct points in the order of the tree, their weights, and which of them each row is; each node's range of
    points (its centre comes first), its radius, and where its children stand in `child`."""

    points: np.ndarray
    weight: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    child: np.ndarray


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of points of whole numbers, exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _split(points: np.ndarray, start: np.ndarray, end: np.ndarray, scale: float) -> np.ndarray:
    """For each point of the groups (ranges start to end) the number of its centre: in each group the first point that
    no centre covers is the next one, and it covers what lies within `scale`."""
    taken = np.zeros(len(points), np.int64)
    group = np.repeat(np.arange(len(start)), end - start)
    open_ = np.concatenate([np.arange(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    turn = 0
    while len(open_):
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        centre = np.repeat(open_[new], np.diff(np.r_[new, len(open_)]))
        near = _distance(points[open_], points[centre]) <= scale * scale
        taken[open_[near]] = turn
        open_, group = open_[~near], group[~near]
        turn += 1
    return taken


def cover_tree(rows: np.ndarray) -> Tree:
    """The cover tree of rows of whole numbers (at least one row)."""
    points, row, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    row = row.reshape(-1)
    order = np.arange(len(points))
    lo, hi, parent = [np.array([0])], [np.array([len(points)])], [np.array([-1])]
    node = np.array([0]) if len(points) > 1 else np.zeros(0, np.int64)  # nodes of more points than one
    start, end, n = np.zeros(len(node), np.int64), np.full(len(node), len(points)), 1
    scale = float(np.sqrt(_distance(points, points[:1]).max()))
    radius = [np.array([scale])]
    while len(node):
        scale /= 2
        taken = _split(points[order], start, end, scale)
        at = np.concatenate([np.arange(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        group = np.repeat(np.arange(len(start)), end - start)
        by = np.lexsort((taken[at], group))  # stable: a centre is the first point that it covers
        order[at] = order[at][by]
        key = np.stack([group, taken[at][by]])
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        a, b, g = at[cut], np.r_[at[cut[1:] - 1], at[-1]] + 1, group[cut]
        reach = np.maximum.reduceat(_distance(points[order[at]], points[order[np.repeat(a, b - a)]]), cut)
        several = np.bincount(g, minlength=len(node))[g] > 1  # an only child is its parent
        name = np.where(several, 0, node[g])
        name[several] = n + np.arange(several.sum())
        n += int(several.sum())
        lo.append(a[several])
        hi.append(b[several])
        parent.append(node[g][several])
        radius.append(np.sqrt(reach[several]))
        more = b - a > 1
        node, start, end = name[more], a[more], b[more]
    lo, hi, parent = np.concatenate(lo), np.concatenate(hi), np.concatenate(parent)
    points, weight = points[order].astype(np.int64), weight[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    child = np.argsort(parent, kind="stable")[1:]
    first = np.searchsorted(parent[child], np.arange(len(lo) + 1))
    return Tree(points, weight, place[row], lo, hi, np.concatenate(radius), first, child)


def nearest(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of points that go to one entry as a whole: starts, ends, entries. The ranges cover all points once; the nearest
    entry is the first of those at the least squared distance."""
    _, only = np.unique(entries, axis=0, return_index=True)  # of equal entries the first wins always
    only.sort()
    node, entry = np.zeros(len(only), np.int64), only
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(node):
        new = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        n = np.diff(np.r_[new, len(node)])
        square = _distance(tree.points[tree.lo[node]], entries[entry])
        leaf = tree.hi[node[new]] - tree.lo[node[new]] == 1
        least = np.minimum.reduceat(square, new)
        far = np.sqrt(square.astype(float))
        reach = np.repeat(np.minimum.reduceat(far, new) + 2 * tree.radius[node[new]], n)
        stays = np.where(np.repeat(leaf, n), square == np.repeat(least, n), far <= reach + 1e-6 + 1e-12 * far)
        left = np.add.reduceat(stays.astype(np.int64), new)
        node, entry = node[stays], entry[stays]
        new = np.cumsum(left) - left
        done = leaf | (left == 1)
        out.append((tree.lo[node[new[done]]], tree.hi[node[new[done]]], entry[new[done]]))
        down = ~np.repeat(done, left)
        node, entry = node[down], entry[down]
        if len(node):  # each child looks at what its parent could not rule out
            k = tree.first[node + 1] - tree.first[node]
            pair = np.repeat(np.arange(len(node)), k)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(k) - k, k)
            node, entry = tree.child[tree.first[node][pair] + nth], entry[pair]
            by = np.lexsort((entry, node))
            node, entry = node[by], entry[by]
    a, b, e = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(a)
    return a[by], b[by], e[by]


def sums(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the rows that are nearest to each entry."""
    total = np.zeros((len(tree.points) + 1, tree.points.shape[1]), np.int64)
    np.cumsum(tree.points * tree.weight[:, None], axis=0, out=total[1:])
    count = np.r_[0, np.cumsum(tree.weight)]
    a, b, e = nearest(tree, entries)
    s, n = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    np.add.at(s, e, total[b] - total[a])
    np.add.at(n, e, count[b] - count[a])
    return s, n


def codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row."""
    a, b, e = nearest(tree, entries)
    entry = np.repeat(e, b - a)
    return entry[tree.row], _distance(tree.points, entries[entry])[tree.row]


def _packed(tree: Tree) -> bytes:
    shape = np.array([tree.points.shape[1], len(tree.points), len(tree.row), len(tree.lo)], np.int32)
    whole = [shape, *(np.ascontiguousarray(x, np.int32).ravel() for x in (tree.points, tree.weight, tree.row, tree.lo, tree.hi, tree.first, tree.child))]
    return b"".join(x.tobytes() for x in whole) + tree.radius.tobytes()


def _unpacked(raw: bytes) -> Tree:
    d, m, n, k = np.frombuffer(raw, np.int32, 4).tolist()
    size = [m * d, m, n, k, k, k + 1, k - 1]
    at = np.cumsum([4, *size])
    x = [np.frombuffer(raw, np.int32, s, 4 * a).astype(np.int64) for s, a in zip(size, at.tolist(), strict=False)]
    return Tree(x[0].reshape(m, d), x[1], x[2], x[3], x[4], np.frombuffer(raw, np.float64, k, 4 * int(at[-1])), x[5], x[6])


def whole_numbers(column: pa.Array, parts: int) -> np.ndarray:
    """Vectors as rows of floor(SCALE * x)."""
    length = np.unique(column.value_lengths().to_numpy())
    if len(length) != 1 or not length[0] or length[0] % parts:
        raise ValueError(f"vectors must have one length that {parts} divides, not {length[:5].tolist()}")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) * SCALE
    if not (np.abs(x) < LIMIT).all():
        raise ValueError(f"scaled components must lie within {LIMIT}")
    return np.floor(x).astype(np.int64)


def _tree_task(parts: int, size: int) -> Callable:
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cut = np.split(whole_numbers(rows.column(2), parts), parts, axis=1)
        ids, label = (pa.array([rows.column(k).to_pylist()], pa.list_(t)) for k, t in ((0, pa.int64()), (1, pa.string())))
        return pa.RecordBatch.from_arrays([ids, label, pa.array([[_packed(cover_tree(x)) for x in cut]], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, size - n)
                held.append(take)
                n += take.num_rows
                batch = batch.slice(take.num_rows)
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return task


def _sum_task(books: np.ndarray) -> Callable:
    parts, k, d = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p in range(parts):
                    s, n = sums(_unpacked(trees[p].as_py()), books[p])
                    total[p] += s
                    count[p] += n
        part, entry, at = (x.ravel() for x in np.indices(total.shape))
        columns = [part, entry, at, total.ravel(), np.repeat(count.ravel(), d)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["part", "entry", "at", "total", "n"])

    return task


def _code_task(books: np.ndarray) -> Callable:
    parts = len(books)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column(0)[k].values, batch.column(1)[k].values
                found = [codes(_unpacked(tree.as_py()), book) for tree, book in zip(batch.column(2)[k], books, strict=True)]
                text = np.stack([f[0] for f in found], 1).astype(np.uint8).tobytes().hex()
                code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    return task


def finite(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """vec_id, label (as text), vector of the rows whose vector has finite components alone."""
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.select(long_id(vectors, id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vector").isNotNull() & whole)


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Each part of the vectors of the least ids: parts x entries x length, of at most `entries` rows."""
    got = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not got:
        return np.zeros((parts, 0, 0), np.int64)
    x = whole_numbers(pa.array([r.vector for r in got], pa.list_(pa.float64())), parts)
    return x.reshape(len(x), parts, -1).swapaxes(0, 1)


def text_of(books: np.ndarray) -> str:
    """All components, by part, entry and position within the part."""
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes (CODES; two hexadecimal digits a part, error: squared distances summed over parts) and the final codebooks."""
    spark = vectors.sparkSession
    rows = finite(vectors, id_col, vector_col, label_col)
    books = first_books(rows, parts, entries)
    work = Scratch(spark, "cover_trees")
    trees = work.kept(rows.mapInArrow(_tree_task(parts, BLOCK), "ids array<long>, labels array<string>, trees array<binary>"), "trees")
    for _ in range(rounds if books.size else 0):
        found = trees.select("trees").mapInArrow(_sum_task(books), "part long, entry long, at long, total long, n long")
        books = books.copy()
        for r in found.groupBy("part", "entry", "at").agg(F.sum("total").alias("s"), F.sum("n").alias("n")).collect():  # as many rows as the codebooks have components
            if r.n:
                books[r.part, r.entry, r.at] = r.s // r.n
    out = kept(trees.mapInArrow(_code_task(books), CODES), "codes")
    work.drop()
    return out, books


def with_label_errors(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code, error, label_error (errors of all rows of the label), codebooks_sha256. A label may hold any share of the rows."""
    coded = coded.select("vec_id", F.coalesce("label", F.lit("")).alias("name"), F.col("label").isNull().alias("none"), "code", "error")
    sums_ = kept(coded.groupBy("name", "none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_errors")
    out = spread_join(coded, sums_.drop("n"), ["name", "none"], sums_)
    digest = hashlib.sha256(text_of(books).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
