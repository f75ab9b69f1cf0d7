"""The trie of the prefixes that conversations share, with sums over its subtrees from an Euler tour.

A conversation's turns are put in order by a sort of all turns over ranges, so a conversation of any length is no
task's alone. A prefix is known by its depth and two running polynomial hashes of its turns (of 128 bits of MD5 over
role and text; sums of ranges are composed at their borders); equal prefixes are one node. No text moves.

Each node has an arc that enters it and one that leaves it. An entering arc is followed by the first child's or the
leaving one; a leaving arc by the next sibling's entering one or the parent's leaving one. The tour of all arcs is a linked
list, ranked over all partitions (`ranking`); the sums over a subtree are the difference of the sums before its two arcs.

Defined results: rows of a null conv_id belong to no conversation and are left out; a null turn comes first; turns of equal
number go by the MD5 of role and text; null roles and texts are empty; repeated rows are turns of their own; conv_ids
that are no integers are refused; an empty table gives no node, not even a root; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .ranking import ranked
from .skew import spread_join
from .store import Scratch, kept, long_id, parts

#: A conversation takes over fewer turns than this from the first of its FAMILY neighbours in number.
HEAD, FAMILY = 9, 5
#: Bases of the two running hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Numbers of one string that is hashed; a task holds few such strings at a time.
IDS = 4096
_NONE = hashlib.sha256(b"").hexdigest()


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent, modulo 2 ** 64."""
    out, e, b = np.ones(len(exponent), W.U64), exponent.copy(), base
    while e.any():
        out = np.where(e & 1, out * W.U64(b), out)
        b, e = b * b % (1 << 64), e >> 1
    return out


def _after(carry: tuple[int, int, int], more: tuple[int, int, int]) -> tuple[int, int, int]:
    """Length and hashes of two runs of turns put one after the other."""
    n = carry[0]
    return (n + more[0], *((c + pow(b, n, 1 << 64) * m) % (1 << 64) for c, m, b in zip(carry[1:], more[1:], BASES, strict=True)))


def _running(conv: np.ndarray, turn: np.ndarray, last: tuple | None) -> tuple[np.ndarray, list[np.ndarray], tuple]:
    """Each turn's place in its conversation, and the running hashes with it; `last` is the conversation that goes on."""
    new = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    size = np.diff(np.r_[new, len(conv)])
    goes_on = last is not None and last[0] == conv[0]
    place = np.arange(len(conv)) - np.repeat(new, size)
    place[: size[0]] += last[1] if goes_on else 0
    sums = []
    for k, base in enumerate(BASES):
        total = np.cumsum(turn[:, k] * _power(base, place), dtype=W.U64)
        sums.append(total - np.repeat(np.r_[W.U64(0), total][new], size))
        sums[k][: size[0]] += W.U64(last[2 + k]) if goes_on else W.U64(0)
    return place, sums, (int(conv[-1]), int(place[-1]) + 1, int(sums[0][-1]), int(sums[1][-1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and running hashes as if every range of the sort began with a new conversation."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        turn = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").astype(W.U64).reshape(-1, 2)
        place, sums, last = _running(batch.column(0).to_numpy(), turn, last)
        columns = [batch.column(0), batch.column(2), pa.array(np.full(len(place), part)), pa.array(place), *(pa.array(s.view(np.int64)) for s in sums), *(pa.array(turn[:, k].copy().view(np.int64)) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "size", "part", "place", "h1", "h2", "t1", "t2"])


def _borders(scanned: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """For each range whose first conversation began before it: that conversation, its length and hashes up to there. The
    driver sees one row a range."""
    ends = scanned.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "h1", "h2")).alias("last")).orderBy("part").collect()
    out, open_ = {}, None
    for r in ends:
        if open_ and open_[0] == r.first:
            out[r.part] = open_
        own = (r.last.place + 1, r.last.h1 % (1 << 64), r.last.h2 % (1 << 64))
        if open_ and open_[0] == r.first == r.last.conv_id:
            own = _after(open_[1:], own)
        open_ = (r.last.conv_id, *own)
    return out


def _join_task(borders: dict[int, tuple[int, int, int, int]]) -> Callable:
    """Adds to the first conversation of each range what came before; the running hashes without the turn itself as well."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, size, part, place, *h = (c.to_numpy() for c in batch.columns)
            place, h = place.copy(), [x.view(W.U64).copy() for x in h]
            for p in np.unique(part).tolist():
                if p in borders:
                    id_, n, *before = borders[p]
                    own = (part == p) & (conv == id_)
                    place[own] += n
                    for k, base in enumerate(BASES):
                        h[k][own] = W.U64(before[k]) + W.U64(pow(base, n, 1 << 64)) * h[k][own]
            old = [h[k] - h[k + 2] * _power(base, place) for k, base in enumerate(BASES)]
            columns = [conv, size, place, *(x.view(np.int64) for x in (*h[:2], *old))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv_id", "size", "place", "h1", "h2", "g1", "g2"])

    return task


def in_order(conversations: DataFrame, work: Scratch) -> DataFrame:
    """conv_id, size (bytes of the text), place (from 0), running hashes with the turn (h1, h2) and before it (g1, g2)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(long_id(conversations, "conv_id").alias("conv_id"), turn.alias("key"), F.octet_length(text).cast("long").alias("size"), "turn")
    rows = rows.where("conv_id is not null")
    by = ["conv_id", "turn", "key"]  # nulls come first
    rows = rows.repartitionByRange(parts(rows.sparkSession), *by).sortWithinPartitions(*by).drop("turn")
    scanned = work.kept(rows.mapInArrow(_scan, "conv_id long, size long, part long, place long, h1 long, h2 long, t1 long, t2 long"), "scanned")
    return scanned.mapInArrow(_join_task(_borders(scanned)), "conv_id long, size long, place long, h1 long, h2 long, g1 long, g2 long")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running hashes of a conversation's own turns once they stand behind the turns that it takes over."""
    for batch in batches:
        c = {n: x.to_numpy() for n, x in zip(batch.schema.names, batch.columns, strict=True)}
        less = c["skip"] - c["taken"]
        out = []
        for which in ("h", "g"):
            for k, base in enumerate(BASES):
                own = (c[f"{which}{k + 1}"].view(W.U64) - c[f"own{k + 1}"].view(W.U64)) * _power(pow(base, -1, 1 << 64), less)
                out.append((c[f"base{k + 1}"].view(W.U64) + own).view(np.int64))
        columns = [c["conv_id"], c["taken"] + c["place"] - c["skip"] + 1, c["size"], c["turns"], *out]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["conv_id", "depth", "size", "turns", "h1", "h2", "g1", "g2"])


def _hash_at(heads: str, n: str, k: int) -> Column:
    """The running hash of the first n turns, from a conversation's first ones."""
    return F.coalesce(F.expr(f"get({heads}, int({n}) - 1).h{k}"), F.lit(0).cast("long"))


def rebuilt(turns: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, depth, size, turns, and the hashes of the prefixes up to there and
    before), and the conversations (conv_id, turns)."""
    head = F.when(F.col("place") < HEAD - 1, F.struct("place", "size", "h1", "h2", "g1", "g2"))
    convs = work.kept(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(head)).alias("heads")), "conversations")
    skip = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD))
    base = convs.select(F.col("conv_id").alias("of"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    plan = convs.withColumns({"skip": skip, "of": F.expr(f"conv_id - conv_id % {FAMILY}")}).join(base, "of", "left")
    plan = plan.withColumn("taken", F.least("skip", F.coalesce("base_n", F.lit(0))))
    plan = plan.withColumn("turns", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("skip")))
    hashes = {f"base{k}": _hash_at("base_heads", "taken", k) for k in (1, 2)} | {f"own{k}": _hash_at("heads", "least(skip, n)", k) for k in (1, 2)}
    plan = work.kept(plan.withColumns(hashes).select("conv_id", "n", "skip", "taken", "turns", *hashes, F.expr("slice(base_heads, 1, int(taken))").alias("heads")), "plan")
    names = ["conv_id", "depth", "size", "turns", "h1", "h2", "g1", "g2"]
    first = plan.select("conv_id", "turns", F.explode("heads").alias("t")).select("conv_id", "turns", "t.*").withColumn("depth", F.col("place") + 1)
    own = spread_join(turns, plan.drop("n", "heads"), ["conv_id"], plan).where("place >= skip")
    own = own.mapInArrow(_moved, "conv_id long, depth long, size long, turns long, h1 long, h2 long, g1 long, g2 long")
    return work.kept(first.select(names).unionByName(own.select(names)), "rebuilt"), plan.select("conv_id", "turns")


def _siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's next sibling (-1: none), by a look at the next row; -2 for the last row of a range."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        parent, id_ = (np.concatenate([*([held[k : k + 1]] if held is not None else []), batch.column(k).to_numpy()]) for k in (0, 1))
        held = np.array([parent[-1], id_[-1]])
        if len(id_) > 1:
            then = np.where(parent[1:] == parent[:-1], id_[1:], -1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (parent[:-1], id_[:-1], then, np.full(len(then), part))], names=["parent", "id", "then", "part"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*held, -2, part)], names=["parent", "id", "then", "part"])


def _with_siblings(nodes: DataFrame, work: Scratch) -> DataFrame:
    """parent, id, then (next sibling or -1) of each node that has a parent. The driver sees one row a range."""
    rows = nodes.where("parent is not null").select("parent", "id")
    rows = rows.repartitionByRange(parts(rows.sparkSession), "parent", "id").sortWithinPartitions("parent", "id")
    rows = work.kept(rows.mapInArrow(_siblings, "parent long, id long, then long, part long"), "siblings")
    ends = rows.groupBy("part").agg(F.min(F.struct("parent", "id")).alias("first"), F.max(F.struct("parent", "id")).alias("last")).orderBy("part").collect()
    over = [(a.last.id, b.first.id if a.last.parent == b.first.parent else -1) for a, b in zip(ends, ends[1:], strict=False)]
    known = F.broadcast(rows.sparkSession.createDataFrame([*over, (-1, -1)], "id long, beyond long"))
    rows = rows.join(known, "id", "left")
    return rows.select("parent", "id", F.when(F.col("then") == -2, F.coalesce("beyond", F.lit(-1))).otherwise(F.col("then")).alias("then"))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most IDS sorted numbers of one node as one string."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)])
        ids = batch.column(3).to_numpy()
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        cut = np.unique(np.r_[cut, np.arange(0, len(ids), IDS)]).astype(int)
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cut, [*cut[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[cut]) for k in key), pa.array(ids[cut]), pa.array(text, pa.string())], names=["depth", "h1", "h2", "conv_id", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's strings, which follow each other."""
    now, digest = None, None
    for batch in batches:
        out = []
        for *key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if key != now:
                out += [(*now, digest.hexdigest())] if now else []
                now, digest = key, hashlib.sha256()
                digest.update(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield _digest_rows(out)
    yield _digest_rows([(*now, digest.hexdigest())] if now else [])


def _digest_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["depth", "h1", "h2", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """ends (depth, h1, h2, conv_id) to the digest of each node's ids. A digest has to see all ids of its node in one
    sequence; they are sorted and turned into strings over all partitions, and the task that hashes streams these."""
    by = ["depth", "h1", "h2", "conv_id"]
    n = parts(ends.sparkSession)
    strings = ends.select(by).repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_strings, "depth long, h1 long, h2 long, conv_id long, text string")
    return strings.repartition(n, *by[:3]).sortWithinPartitions(*by).mapInArrow(_digests, "depth long, h1 long, h2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and
    place (of its entering arc in the tour) of each node. A parent or a node may hold any share of all."""
    spark = conversations.sparkSession
    work = Scratch(spark, "prefixes")
    turns, convs = rebuilt(work.kept(in_order(conversations, work), "turns"), work)
    nodes = turns.groupBy("depth", "h1", "h2").agg(F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in ("conv_id", "size", "g1", "g2")))
    zero = F.lit(0).cast("long")
    none = {c: zero for c in ("depth", "h1", "h2", "size", "g1", "g2")}
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").withColumns(none)
    nodes = nodes.unionByName(root).repartitionByRange(parts(spark), "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    nodes = work.kept(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # in the order of conv_id and depth

    key = ["up", "g1", "g2"]
    above = nodes.select(F.col("depth").alias("up"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = spread_join(nodes.where("depth > 0").withColumn("up", F.col("depth") - 1), above, key)
    columns = ["id", "conv_id", "depth", "h1", "h2", "n_convs", "size", "parent", "parent_conv_id"]
    top = nodes.where("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    nodes = work.kept(below.select(columns).unionByName(top.select(columns)), "with_parents")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"), F.min("id").alias("child"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = work.kept(nodes, "with_children")

    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    saved = (F.col("n_convs") - 1) * F.col("size")
    entering = nodes.select(enter.alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("next"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("a"), saved.alias("b"))
    leaving = _with_siblings(nodes, work)
    leaving = leaving.select(leave.alias("arc"), F.when(F.col("then") >= 0, F.col("then") * 2).otherwise(F.col("parent") * 2 + 1).alias("next"), zero.alias("a"), zero.alias("b"))
    last = nodes.where("depth = 0").select(leave.alias("arc"), F.lit(-1).cast("long").alias("next"), zero.alias("a"), zero.alias("b"))
    tour = ranked(entering.unionByName(leaving).unionByName(last), work)
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    sums = tour.groupBy(F.shiftright("arc", 1).alias("id")).agg(F.sum(sign * F.col("a")).alias("n_leaves"), F.sum(sign * F.col("b")).alias("saved_tokens"), F.min("n").alias("place"))

    ends = turns.where("depth = turns").select("depth", "h1", "h2", "conv_id")
    ends = _ends(ends.unionByName(convs.where("turns = 0").select(*(zero.alias(c) for c in ("depth", "h1", "h2")), "conv_id")))
    out = nodes.join(sums, "id").join(ends, ["depth", "h1", "h2"], "left")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"), "place")
    out = kept(out, "trie")
    work.drop()
    return out
