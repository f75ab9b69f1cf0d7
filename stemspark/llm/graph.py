"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import spread_join
from .store import Scratch, kept


def _least(both: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself, and its number of links; sums are made before the shuffle, so a node may
    have any number."""
    return both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of integers to (node, component): the least node that can be reached, for every node with a link.

    Links of a node to itself and nulls don't count. The table of edges is written in the shared folder after each
    round; the number of rounds grows with the logarithm of the longest path. A node with any share of all links is
    dealt over all partitions.
    """
    work = Scratch(links.sparkSession, "components")
    a, b = F.least("a", "b"), F.greatest("a", "b")
    edges = links.where("a <> b").select(b.alias("u"), a.alias("v")).distinct()
    edges = work.kept(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.kept(_least(both), "least")
        large = spread_join(both.where("v > u"), least.drop("n"), ["u"], least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.kept(large.where("u <> v").distinct(), "large")
        near = work.kept(_least(large), "near")  # here u > v always
        small = spread_join(large, near.drop("n"), ["u"], near)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        edges = work.kept(small.distinct(), "edges")
        was, state = state, _state(edges)
        if was == state:
            break
    found = kept(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "components")
    work.drop()
    return found
