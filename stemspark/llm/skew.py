"""Joins whose left side may hold any share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import parts

#: A key is heavy if it holds more than this part of all rows; there are fewer heavy keys than that.
HEAVY = 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weights: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """The inner (or left) join of left with right (any columns beside the keys; null keys meet nothing).

    Rows of left under a heavy key are dealt over all partitions by a salt, and right's rows of that key go to each of
    them. weights (keys, n: rows of left) tells heavy keys; without it they are counted, with sums before the shuffle.
    Fewer than HEAVY keys are broadcast, whatever the size of the tables.
    """
    spark = left.sparkSession
    weights = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if weights is None else weights.select(*keys, "n")
    total = weights.agg(F.sum("n")).first()[0] or 0
    heavy = weights.where(F.col("n") > max(1, total // HEAVY)).select(*keys)
    if heavy.isEmpty():
        return left.join(right, keys, how)
    known = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    n = parts(spark)
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(F.struct(*left.columns)), F.lit(n)).cast("int")).otherwise(0)
    salts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(known, keys, "left").withColumn("_salt", salt).drop("_heavy")
    right = right.join(known, keys, "left").withColumn("_salt", F.explode(salts)).drop("_heavy")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
