"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct shingles. Each of its registers holds the exponentially spaced, truncated
minimum of a hash over that set; registers of two sets merge by taking the greater. Bands of registers are the
keys under which similar sets meet. In a bucket all meet its least member, the pivot; similarity is estimated from
both sketches jointly by likelihood, pairs whose estimate lies more than MARGIN below a link's similarity are given up,
and the others are confirmed on the full sets.

All pairs of a bucket are never made. Documents of equal sets are one from the start. Each member is compared with
the pivot of its bucket. Of the rest, only pairs that can still join two components are looked at: one of
them isn't linked with the pivot, their sizes allow it, and their distances to the pivot differ by no more than
the distance of a link (the Jaccard distance obeys the triangle inequality; a distance that is only estimated gets MARGIN
more). That happens inside a task that holds a bounded block of the pivot's group; larger groups are cut into blocks
whose open members meet in pairs of blocks. Buckets, pivots and equal sets that any share of all documents belong to
are dealt over all partitions where they are joined.

A link is lost by chance alone: one of similarity 0.75 shares no band with probability (1 - 0.75^4)^40 < 3e-7, and has an
estimate below the margin with probability < 1e-8. Both fall with the similarity.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a null id gets a null
component and is kept; rows of one doc_id are one node; ids that are no integers are refused; an empty table gives an
empty table; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .skew import spread_join
from .store import Scratch, kept, long_id, parts

SHINGLE = 5
#: Similarity of a link, in hundredths.
LINK = 75
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Base of the registers' spacing and rate of the exponential law.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: How far below the threshold an estimate may lie before a pair is given up: six standard deviations.
MARGIN = 6 * np.sqrt(LINK / 100 * (1 - LINK / 100) / REGISTERS)
#: A block of a group holds about so many documents and shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 2_000_000

_KEYS = W.mix(np.arange(1, 2 * REGISTERS + 1, dtype=W.U64), 0x243F6A8885A308D3)
_XOR = (_KEYS[:REGISTERS] >> W.U64(32)).astype(np.uint32)[:, None]
_FACTOR = ((_KEYS[REGISTERS:] >> W.U64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def shingle_sets(block: W.Block, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    found = W.words(block, lower=True)
    start, h = W.windows(found, size)
    at = np.searchsorted(start, found.at)
    few = np.flatnonzero((np.diff(found.at) > 0) & (np.diff(found.at) < size))
    short = dict(zip(few.tolist(), W.range_hash(found, found.at[few], found.at[few + 1]), strict=True))
    for k in range(len(block.at) - 1):
        yield np.array([short[k]], W.U64) if k in short else np.unique(h[at[k] : at[k + 1]])


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes, 16 bits each; all 0 for the empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> W.U64(32)).astype(np.uint32)[None, :]
    for k in range(0, h.shape[1], 512):
        np.minimum(low, ((h[:, k : k + 512] ^ _XOR) * _FACTOR).min(1), out=low)
    x = -np.log1p(-(low.astype(float) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(x: np.ndarray, n_x: float, y: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Jaccard similarity of a set (registers x, size n_x) with others (rows of y, sizes n_y), by maximum likelihood."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = y.shape[1] - more - less
    u, v = n_x / (n_x + n_y), n_y / (n_x + n_y)
    top = np.minimum(u / v, v / u)
    step = (BASE - 1) / BASE

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = -np.log1p(-np.maximum(u - v * j, 1e-12) * step) / np.log(BASE)
        q = -np.log1p(-np.maximum(v - u * j, 1e-12) * step) / np.log(BASE)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    lo, hi, cut = np.zeros_like(top), top, (5**0.5 - 1) / 2
    a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
    fa, fb = likelihood(a), likelihood(b)
    for _ in range(16):
        left = fa >= fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        fa, fb = likelihood(a), likelihood(b)
    return (lo + hi) / 2


def _sketch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(BANDS, dtype=W.U64) * W.U64(0x9E3779B97F4A7C15)
    for batch in batches:
        n, one, two, keys = [], [], [], []
        for block in W.blocks(batch.column(1)):
            for s in shingle_sets(block):
                r = registers(s)
                n.append(len(s))
                one.append(W.mix(s, 1).sum(dtype=W.U64))
                two.append(W.mix(s, 2).sum(dtype=W.U64))
                keys.append(W.mix(W.mix(r.view(W.U64).copy(), 3) + band))
        flat = np.concatenate(keys) if keys else np.zeros(0, W.U64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(flat.view(np.int64)))
        as_long = lambda x: pa.array(np.array(x, W.U64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), as_long(one), as_long(two), lists], names=["doc_id", "n", "one", "two", "bands"]
        )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), one and two (fingerprint of the set), bands (a key for each band of its registers)."""
    rows = docs.select(long_id(docs), "text")
    return rows.mapInArrow(_sketch_task, "doc_id long, n long, one long, two long, bands array<long>")


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    import zstandard

    for batch in batches:
        zip_ = zstandard.ZstdCompressor(level=3)
        text = [zip_.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary())], names=["doc_id", "packed"])


def _set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a compressed text, with its registers and set instead."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            texts = pa.array([unzip.decompress(x).decode() for x in part.columns[-1].to_pylist()], pa.string())
            sets = [s for block in W.blocks(texts) for s in shingle_sets(block)]
            regs = pa.array([registers(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], regs, pa.array([s.tobytes() for s in sets], pa.binary())], names=[*part.schema.names[:-1], "regs", "shingles"])


def _with_sets(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """rows (with doc_id) with registers and sets of their documents, computed after the join from the whole texts.

    The join is merged at every size: what it moves is the texts, whichever side is the smaller."""
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    joined = rows.join(packed.hint("merge"), "doc_id").select(*rows.columns, "packed")
    return joined.mapInArrow(_set_task, f"{named}, regs binary, shingles binary")


class _Members:
    """Documents of a block: ids, sizes, registers, sets, and distances to the pivot once they are known."""

    def __init__(self, rows: list[tuple]):
        self.id = np.array([r[0] for r in rows], np.int64)
        sets = [np.frombuffer(r[2], W.U64) for r in rows]
        self.n = np.array([len(s) for s in sets], np.int64)
        self.regs = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(len(rows), REGISTERS)
        self.sets = sets
        self.far = np.array([r[3] if len(r) > 3 and r[3] is not None else np.nan for r in rows])

    def shared(self, s: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of s with some members."""
        out = np.zeros(len(which), np.int64)
        for lo in range(0, len(which), 256):
            some = [self.sets[k] for k in which[lo : lo + 256]]
            flat = np.concatenate(some)
            at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
            out[lo : lo + 256] = W.per_text(s[at] == flat, np.r_[0, np.cumsum([len(x) for x in some])])
        return out


def _loose(far: np.ndarray) -> np.ndarray:
    """How far a distance to the pivot may be off: those beyond what the margin lets through are estimates."""
    return np.where(far > 1 - LINK / 100 + MARGIN, MARGIN, 0.0)


def _linked(shared: np.ndarray, n_x: int, n_y: np.ndarray) -> np.ndarray:
    return 100 * shared >= LINK * (n_x + n_y - shared)


def _residual(some: _Members, open_: np.ndarray, all_: _Members, same: bool) -> list[tuple[int, int]]:
    """Links that join members which are not linked with the pivot to others, a spanning forest of them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if same:  # what is linked with the pivot is one component
        rest = np.flatnonzero(~open_)
        for k in rest:
            root[int(some.id[k])] = int(some.id[rest[0]])
    out, reach = [], 1 - LINK / 100 + 1e-9
    all_loose, some_loose = _loose(all_.far), _loose(some.far)
    done = np.zeros(len(all_.id), bool)
    for k in np.flatnonzero(open_):
        n = int(some.n[k])
        if same:
            done[k] = True
        may = ~done & (100 * np.minimum(all_.n, n) >= LINK * np.maximum(all_.n, n)) & (np.abs(all_.far - some.far[k]) <= reach + all_loose + some_loose[k]) & (all_.id != some.id[k])
        which = np.flatnonzero(may)
        if not len(which):
            continue
        which = which[estimate(some.regs[k], float(n), all_.regs[which], all_.n[which].astype(float)) >= LINK / 100 - MARGIN]
        if not len(which):
            continue
        for j in which[_linked(all_.shared(some.sets[k], which), n, all_.n[which])]:
            a, b = find(int(some.id[k])), find(int(all_.id[j]))
            if a != b:
                root[a] = b
                out.append((int(some.id[k]), int(all_.id[j])))
    return out


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows of equal keys (the first columns), from batches that are sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


_OUT = "a long, b long, far double"


def _links(rows: list[tuple]) -> pa.RecordBatch:
    a, b, far = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(far, pa.float64())], names=["a", "b", "far"])


def _group_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a block of a pivot's group: (member, pivot), and (member, member) where that joins components.

    Columns: pivot, block, blocks, doc_id, regs, shingles; the pivot is a row of every block. Of groups with
    several blocks also (member, pivot, distance) of every member whose links to other blocks are open."""
    for (pivot, _, n_blocks), rows in _runs(batches, 3):
        heads = [r for r in rows if r[0] == pivot]
        rest = [r for r in rows if r[0] != pivot]
        if not heads or not rest:
            continue
        out: list[tuple] = []
        members = _Members(rest)
        for head in heads:
            s = np.frombuffer(head[2], W.U64)
            near = estimate(np.frombuffer(head[1], np.uint16), float(len(s)), members.regs, members.n.astype(float))
            likely = np.flatnonzero(near >= LINK / 100 - MARGIN)
            members.far, linked = np.maximum(1 - near, 1 - LINK / 100 + MARGIN + 1e-9), np.zeros(len(rest), bool)
            if len(likely):
                shared = members.shared(s, likely)
                linked[likely] = _linked(shared, len(s), members.n[likely])
                members.far[likely] = 1 - shared / (len(s) + members.n[likely] - shared)
            out += [(int(x), pivot, None) for x in members.id[linked]]
            out += [(a, b, None) for a, b in _residual(members, ~linked, members, True)]
            if n_blocks > 1:
                out += [(int(x), pivot, float(d)) for x, d in zip(members.id, members.far, strict=True)]
        yield _links(out)


def _cross_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between open members of one block and members of another block of the same group.

    Columns: pivot, block, other, asks, doc_id, regs, shingles, distance to the pivot."""
    for _, rows in _runs(batches, 3):
        ask = [r[1:] for r in rows if r[0]]
        rest = [r[1:] for r in rows if not r[0]]
        if ask and rest:
            some = _Members(ask)
            yield _links([(a, b, None) for a, b in _residual(some, np.ones(len(ask), bool), _Members(rest), False)])


def links(docs: DataFrame, known: DataFrame, work: Scratch) -> DataFrame:
    """a, b of links between representatives (known: sketches, one row a set) that suffice for the components; work holds
    what they are read from."""
    spark = docs.sparkSession
    n = parts(spark)
    keyed = known.where("n > 0").select("doc_id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("pivot")).where("n > 1")
    buckets = work.kept(buckets, "buckets")
    met = spread_join(keyed, buckets.drop("n"), ["key"], buckets)
    pairs = work.kept(met.where("doc_id <> pivot").select("doc_id", "pivot").distinct(), "pairs")
    packed = docs.select(long_id(docs), "text").mapInArrow(_pack_task, "doc_id long, packed binary")
    weight = known.select("doc_id", F.col("n").alias("weight"))
    groups = pairs.join(weight, "doc_id").groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.sum("weight").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_DOCS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    groups = work.kept(groups.select("pivot", "members", blocks.alias("blocks")), "groups")
    weights, groups = groups.select("pivot", F.col("members").alias("n")), groups.drop("members")
    members = spread_join(pairs, groups, ["pivot"], weights).select("pivot", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "blocks", "doc_id")
    heads = groups.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", F.col("pivot").alias("doc_id"))
    rows = _with_sets(members.unionByName(heads), packed)
    dealt = rows.repartition(n, "pivot", "block").sortWithinPartitions("pivot", "block")
    found = work.kept(dealt.mapInArrow(_group_task, _OUT), "links")
    sure = found.where("far is null").select("a", "b")
    return sure.unionByName(_cross(found.where("far is not null"), groups, packed, n))


def _cross(open_: DataFrame, groups: DataFrame, packed: DataFrame, n: int) -> DataFrame:
    """Links across the blocks of the groups that have several: members not linked with the pivot ask, in pairs of blocks."""
    reach = 1 - LINK / 100
    rows = open_.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), "far").join(groups.where("blocks > 1"), "pivot")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    asking = rows.where(F.col("far") > reach)
    least = asking.groupBy("pivot").agg(F.min("far").alias("least"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = asking.withColumn("other", every).where("block <> other").select("pivot", "block", "other", F.lit(True).alias("asks"), "doc_id", "far")
    right = rows.join(least, "pivot").where(F.col("far") >= F.col("least") - reach - 1e-9).withColumnRenamed("block", "other")
    right = right.withColumn("block", every).where("block <> other").select("pivot", "block", "other", F.lit(False).alias("asks"), "doc_id", "far")
    rows = _with_sets(left.unionByName(right), packed).select("pivot", "block", "other", "asks", "doc_id", "regs", "shingles", "far")
    return rows.repartition(n, "pivot", "block", "other").sortWithinPartitions("pivot", "block", "other").mapInArrow(_cross_task, _OUT).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach), kept (doc_id = component_id), for each row."""
    work, known = Scratch(docs.sparkSession, "near"), kept(sketches(docs), "sketches")
    named = known.where("n > 0 and doc_id is not null").withColumnRenamed("n", "size")
    same = named.groupBy("size", "one", "two").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = work.kept(same, "equal_sets")
    at_first = (F.col("doc_id") == F.col("first")) & (named["size"] == same["size"]) & (named.one == same.one) & (named.two == same.two)
    once = named.join(same, at_first, "left_semi").select("doc_id", F.col("size").alias("n"), "bands")
    met = links(docs.where("doc_id is not null"), once, work)
    # rows of one doc_id with different texts are one node: each of its sets is linked with it
    again = same.where("n > 1")
    own = spread_join(named.drop("bands"), again.drop("n"), ["size", "one", "two"], again)
    own = own.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b")
    found = components(met.unionByName(own))
    work.drop()
    out = known.join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
