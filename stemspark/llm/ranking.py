"""List ranking: where each arc of a linked list stands, and the sums of all before it.

A round deals the arcs that are left over partitions and shortens every chain that lies inside one: its first arc stays
and takes the weights of the chain, the others remember it and what stands between. The first round deals by ranges of
arcs, as neighbours often have neighbouring numbers; later ones toss a coin for each arc and deal heads by their
successor and tails by themselves, so that a head meets a tail that follows it: a quarter of what is left goes
in a round, whatever the order of the numbers. Once LOCAL arcs are left, one task ends the work; then the rounds are undone.
A partition holds about LOCAL arcs; rounds grow with the logarithm of the list and their work sums to a multiple of it.

Defined results: each list of several starts at 0; an empty table gives an empty table; a cycle is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, parts

#: So many arcs are ranked in one task, and a partition of a round has about as many.
LOCAL = 1 << 16

_ROUND = "arc long, first long, n long, a long, b long, next long, all_n long, all_a long, all_b long"


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each arc's first one in this partition and the sums between; for first ones what follows and the chain's sums."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    arc, next_ = table.column(0).to_numpy(), table.column(1).to_numpy()
    weight = np.stack([table.column(k).to_numpy() for k in (2, 3, 4)], 1)
    order = np.argsort(arc)
    arc, next_, weight = arc[order], next_[order], weight[order]
    at = np.minimum(np.searchsorted(arc, next_), len(arc) - 1)
    inside = arc[at] == next_
    first, between = np.arange(len(arc)), np.zeros_like(weight)
    before = np.flatnonzero(inside)
    first[at[before]] = before
    between[at[before]] = weight[before]
    for _ in range(len(arc).bit_length() + 1):
        further = first[first]
        if (further == first).all():
            break
        between += between[first]
        first = further
    else:
        raise ValueError("the list has a cycle")
    end = np.flatnonzero(~inside)
    follows, total = np.full(len(arc), -1), np.zeros_like(weight)
    follows[first[end]] = next_[end]
    total[first[end]] = between[end] + weight[end]
    columns = [arc, arc[first], *between.T, follows, *total.T]
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[x.split()[0] for x in _ROUND.split(", ")])


def ranked(arcs: DataFrame, work: Scratch) -> DataFrame:
    """arcs (arc, next, a, b; numbers from 0 on, next is -1 at the end) to arc, n, a, b: how many arcs come before, and the
    sums of their a and b. Written in `work`."""
    left, rounds = work.kept(arcs.select("arc", "next", F.lit(1).cast("long").alias("n"), "a", "b"), "arcs"), []
    while True:
        size = left.count()
        if size <= LOCAL:
            dealt = left.coalesce(1)
        elif not rounds:
            dealt = left.repartitionByRange(max(parts(left.sparkSession), -(-size // LOCAL)), "arc")
        else:
            coin = F.pmod(F.xxhash64("arc", F.lit(len(rounds))), F.lit(2)) == 0
            dealt = left.repartition(-(-size // LOCAL), F.when(coin & (F.col("next") >= 0), F.col("next")).otherwise(F.col("arc")))
        rounds.append(work.kept(dealt.mapInArrow(_shorten, _ROUND), "round"))
        if size <= LOCAL:
            break
        kept_ = rounds[-1].where("arc = first")
        left = work.kept(kept_.select("arc", "next", F.col("all_n").alias("n"), F.col("all_a").alias("a"), F.col("all_b").alias("b")), "left")
    found = rounds.pop().select("arc", "n", "a", "b")
    for shortened in reversed(rounds):
        firsts = found.select(F.col("arc").alias("first"), *(F.col(c).alias(f"first_{c}") for c in "nab"))
        sums = (F.col(c) + F.col(f"first_{c}") for c in "nab")
        found = shortened.join(firsts, "first").select("arc", *(s.alias(c) for s, c in zip(sums, "nab", strict=True)))
        found = work.kept(found, "ranked")
    return found
