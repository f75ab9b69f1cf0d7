"""Best-fit packing of token sequences by linear grouping.

Large lengths are sorted, cut into groups of equal cardinality and rounded up to the longest of the group; how
many bins of each configuration of these few sizes are needed is a linear programme, solved by column generation.
Actual documents then take the places of a configuration: its longest places those of their groups, longest first, and its
shortest place, whose room the others' rounding has widened, the longest document that fits there. What the whole
numbers of bins leave over and then the small lengths go where they fit best: into the room that is left in the
bins of configurations, and into bins of their own. Several numbers of groups compete, and where plain best fit would need fewer bins than the
best of them, the least-filled bins are emptied and packed again until it doesn't.

All of this works on counts: at most `capacity` lengths go to the driver, and what comes back is a list of classes
of equal bins whose size depends on the capacity alone. Documents find their places by their rank among the pieces
of equal length.

Defined results: a null or empty text is its end id alone; rows of one doc_id are packed each by itself; null ids
of documents are kept as null; ids that are no integers are refused; an empty table gives no rows; other columns don't
matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import kept, long_id, parts
from .tokens import BLOCK_BYTES, encoder

CAPACITY = 1024
#: The finest grouping; half and a quarter as many groups compete with it.
GROUPS = 256
#: A length of at most this share of the capacity is small.
SMALL = 1 / 8
#: How many configurations one search for worthy ones brings.
COLUMNS = 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def _piece_task(path: str, end_id: int, capacity: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(path, end_id), 0
        for batch in batches:
            for block in W.blocks(batch.column(1), BLOCK_BYTES):
                ids, at = coder.encode(block)
                size = np.diff(at)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                short = size - (n - 1) * capacity  # the first piece takes what is over
                start = np.where(piece > 0, short[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, short[doc])
                raw, lo = memoryview(ids.astype("<u4")).cast("B"), at[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + block.first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(doc + row)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
                )
                row += len(size)

    return task


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every text's ids (with end_id): at most `capacity` ids each, only longer texts are cut."""
    rows = docs.select(long_id(docs), "text")
    return rows.mapInArrow(_piece_task(tokenizer, end_id, capacity), PIECES)


def _worthy(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The most worthy configuration that holds each size (how many of each, sizes with repetition): COLUMNS best ones, best first."""
    best, take, at = np.zeros(capacity + 1), np.full(capacity + 1, -1), np.zeros(capacity + 1, np.int64)
    order = np.argsort(sizes)
    s, w = sizes[order], worth[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(int(s[0]), capacity + 1):
        best[c], at[c] = best[c - 1], at[c - 1]
        value = best[c - s[: fits[c]]] + w[: fits[c]]
        j = int(value.argmax())
        if value[j] > best[c] + 1e-12:
            best[c], take[c], at[c] = value[j], order[j], c
    first = np.argsort(-(worth + best[capacity - sizes]), kind="stable")[:COLUMNS]
    out = np.zeros((len(first), len(sizes)), np.int64)
    for row, j in zip(out, first.tolist(), strict=True):
        row[j] += 1
        c = at[capacity - sizes[j]]
        while take[c] >= 0:
            row[take[c]] += 1
            c = at[c - sizes[take[c]]]
    return out


#: The inverse of the basis is computed anew after so many steps, and the search ends after so many without gain.
FRESH, STUCK = 200, 400


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how many bins of each cover `need`, fractions allowed: within half a bin of the fewest.

    Column generation: the basis takes in the most worthy configuration at its prices, until by these prices no set of
    bins can be better by half a bin. Needs are made a little different so that no step is without gain; if STUCK steps bring
    none all the same, or the basis can't be inverted any more, what is there stands: it covers `need` as well."""
    k = len(sizes)
    need = need * (1 + 1e-7 * np.arange(1, k + 1) / k)
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(patterns))
    level = inverse @ need
    pool = np.zeros((0, k), np.int64)
    best, steps, since = level.sum(), 0, 0
    while since < STUCK:
        price = inverse.sum(0)
        value = pool @ price
        if not len(pool) or value.max() <= 1 + 1e-6:
            pool = _worthy(sizes, price, capacity)
            value = pool @ price
            total = level.sum()
            if value[0] <= 1 + 1e-9 or total - total / value[0] < 0.5:
                break
        new = pool[int(value.argmax())]
        d = inverse @ new
        ratio = np.full(k, np.inf)
        np.divide(level, d, out=ratio, where=d > 1e-11)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        patterns[:, out] = new
        steps, since = steps + 1, since + 1
        if steps % FRESH:
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
            level = np.maximum(level - d * ratio[out], 0)
            level[out] = ratio[out]
        else:
            try:
                inverse = np.linalg.inv(patterns)
            except np.linalg.LinAlgError:
                level[out] = ratio[out]
                break
            level = np.maximum(inverse @ need, 0)
        if level.sum() < best * (1 - 1e-7):
            best, since = level.sum(), 0
    return [(patterns[:, j].astype(np.int64), float(level[j])) for j in range(k)]


class _Bins:
    """Classes of equal bins by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room = capacity, [], {}

    def add(self, n: int, items: tuple[int, ...]) -> None:
        if n:
            room = self.capacity - sum(items)
            if room not in self.by_room:
                insort(self.rooms, room)
                self.by_room[room] = []
            self.by_room[room].append((n, items))

    def fit(self, length: int, n: int) -> None:
        """Put n items where the least room stays."""
        while n:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                each = self.capacity // length
                self.add(n // each, (length,) * each)
                self.add(int(n % each > 0), (length,) * (n % each))
                return
            room = self.rooms[k]
            count, items = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[k]
            use = min(n, count)
            self.add(count - use, items)
            self.add(use, (*items, length))
            n -= use

    def classes(self) -> list[tuple[int, tuple[int, ...]]]:
        return [c for room in self.rooms for c in self.by_room[room]]


Classes = list[tuple[int, tuple[int, ...]]]


def _filled(full: Classes, left: dict[int, int], capacity: int, room: int) -> Classes:
    """The bins of configurations with what is left in them and in bins of its own; those with at least `room` tokens free
    are emptied first."""
    bins, again = _Bins(capacity), dict(left)
    for n, items in full:
        if capacity - sum(items) < room:
            bins.add(n, items)
        else:
            for s in items:
                again[s] = again.get(s, 0) + n
    for s in sorted(again, reverse=True):
        bins.fit(s, again[s])
    return bins.classes()


def n_bins(classes: Classes) -> int:
    return sum(n for n, _ in classes)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Classes:
    """Classes of equal bins, (number of bins, lengths in one), that hold counts[length] items of each length: never more bins than
    best fit of the lengths in falling order."""
    tokens = sum(s * n for s, n in counts.items())
    tried: list[tuple[Classes, dict[int, int]]] = []
    found: list[Classes] = []
    for g in dict.fromkeys(max(1, groups // k) for k in (4, 2, 1)):
        tried.append(grouped(counts, capacity, g))
        found.append(_filled(*tried[-1], capacity, capacity + 1))
        if n_bins(found[-1]) * capacity < tokens + capacity:  # no plan has fewer
            break
    k = min(range(len(found)), key=lambda i: n_bins(found[i]))
    plain = n_bins(_filled([], {s: n for s, n in counts.items() if n > 0}, capacity, 0))
    out, room = found[k], capacity // 4
    while n_bins(out) > plain:
        out, room = _filled(*tried[k], capacity, room), room // 2 if room > 1 else room - 1
    return out


def grouped(counts: dict[int, int], capacity: int, groups: int) -> tuple[Classes, dict[int, int]]:
    """Classes of bins that the configurations of the grouped large lengths fill, and the counts of what is left."""
    full: Classes = []
    left = {s: n for s, n in counts.items() if n > 0}
    large = np.array(sorted((s for s in left if s > SMALL * capacity), reverse=True), np.int64)
    if not len(large):
        return full, left
    n = np.array([left[s] for s in large])
    upto = np.cumsum(n)
    size_of_group = -(-int(upto[-1]) // groups)
    group = (upto - 1) // size_of_group  # all items of a length go with its last one
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    sizes, need = large[first], np.bincount(group, n)
    longest = [large[group == g].tolist() for g in range(len(sizes))]  # of each group, those that are left, longest first
    lengths = large[::-1].tolist()  # that are left
    group_of = dict(zip(large.tolist(), group.tolist(), strict=True))

    def documents(places: list[int]) -> dict[int, int] | None:
        """Lengths for one bin: of the groups of all places but the last, and the longest that fits the last."""
        used: dict[int, int] = {}
        room = capacity
        for g in places[:-1]:
            s = next((x for x in longest[g] if left[x] > used.get(x, 0)), None)
            if s is None:
                return None
            used[s] = used.get(s, 0) + 1
            room -= s
        for k in range(bisect_right(lengths, room) - 1, -1, -1):
            if left[lengths[k]] > used.get(lengths[k], 0):
                used[lengths[k]] = used.get(lengths[k], 0) + 1
                return used
        return None

    for pattern, level in sorted(configurations(sizes, need, capacity), key=lambda x: -x[1]):
        whole = int(level + 1e-6)
        places = np.repeat(np.arange(len(sizes)), pattern).tolist()  # groups of longer documents first
        while whole and places and (used := documents(places)):
            run = min(whole, *(left[s] // n for s, n in used.items()))  # as many equal bins as there are of these lengths
            full.append((run, tuple(s for s, n in used.items() for _ in range(n))))
            whole -= run
            for s, n in used.items():
                left[s] -= n * run
                if not left[s]:
                    longest[group_of[s]].remove(s)
                    lengths.remove(s)
    return full, left


def _place_task(rows: list[tuple[int, int, int, int]]) -> Callable:
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    length, first, base, offset = table.T
    starts = {int(s): (int(a), int(b)) for s, a, b in zip(*_runs(length), strict=True)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            size = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            found = np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                a, b = starts[s]
                at = size == s
                found[at] = a + np.searchsorted(first[a:b], rank[at], "right") - 1
            out = [batch.column(k) for k, name in enumerate(names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(base[found] + rank - first[found]), pa.array(offset[found])], names=[*(x for x in names if x != "rank"), "sequence_id", "offset"])

    return task


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value, first, n = np.unique(x, return_index=True, return_counts=True)
    return value, first, first + n


def places(classes: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int]]:
    """For each run of places of a length: the length, the rank of its first place, the first bin, the offset there."""
    used: dict[int, int] = {}
    out, base = [], 0
    for n, items in classes:
        offset = 0
        for s in items:
            rank = used.get(s, 0)
            out.append((s, rank, base, offset))
            used[s] = rank + n
            offset += s
        base += n
    return out


def pack(cut: DataFrame, order: list[str], capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """cut (with a column length, 1 to capacity) with sequence_id and offset; `order` tells equal lengths apart.

    Ranks within a length are counted in shares of it, dealt by a hash, so that no task gets all pieces of a length.
    """
    spark = cut.sparkSession
    n = parts(spark)
    share = F.pmod(F.xxhash64(*order), F.lit(n)).cast("int")
    cut = cut.withColumn("share", share)
    sizes = kept(cut.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = places(plan(counts, capacity, groups))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy(*order)
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["length", "share"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("before", "share")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_place_task(rows), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    cut = pieces(docs, tokenizer, end_id, capacity).withColumn("part", F.spark_partition_id())
    cut = kept(cut, "pieces")
    out = pack(cut, ["doc_id", "part", "row", "piece"], capacity, groups)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
