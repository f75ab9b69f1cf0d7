"""Shards of bounded bytes by extendible hashing, in DataFrame operations alone.

A document's key is 60 bits of the MD5 of its id. The directory begins with one bucket; a bucket over the byte limit
splits on the next bit of the key, until each fits or holds a single key. Several bits are looked at in one round:
bytes are summed for each cell of STEP more bits (before the shuffle first), and sums of shorter prefixes come
from the cells. Only the keys of buckets that are still too large go into the next round, which looks at LATER more bits: such a
bucket holds a few limits of bytes as a rule, and cells that hold one document each would sum up nothing.

Defined results: a null text has no bytes; a null id has the key of the empty string; rows of one id stay together,
and a bucket that such a key, or one document, makes larger than the limit is marked oversized; an empty table
gives an empty table; other columns are kept by write(), whatever their names, and don't matter else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, kept, parts

BITS = 60
STEP = 12
LATER = 4
SHARD_BYTES = 64 << 20


def key(id_: Column) -> Column:
    """The first 60 bits of the MD5 of an id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _reach(base: int) -> int:
    """How many bits a round looks at whose buckets have `base` bits."""
    return min(BITS, base + (min(STEP, LATER) if base else STEP))


def _prefix(bits: int) -> Column:
    return F.shiftright("key", BITS - bits)


def _directory(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """For each cell of the bits that a round looks at: depth, shard, bytes, rows, oversized of its bucket; depth is null if none fits."""
    bits = _reach(base)
    cells = rows.groupBy(_prefix(bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    first = base + 1 if base else 0
    upward = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(bits))))
    upward = upward.withColumn("shard", F.expr(f"shiftright(cell, {bits} - depth)"))
    buckets = upward.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")))
    fits = fits.select("depth", "shard", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))
    found = upward.select("cell", "depth", "shard").join(fits, ["depth", "shard"], "left")
    entry = F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "shard", "shard_bytes", "shard_docs", "oversized"))
    return found.groupBy("cell").agg(F.min(entry).alias("e")).select("cell", "e.*")


def directory(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id") -> list[tuple[int, DataFrame]]:
    """For each round its bits and cells; a cell without depth is looked up in the next round's."""
    rows = docs.select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key(F.col(id_col)).alias("key"))
    rows, base, out = kept(rows, "keys"), 0, []
    while True:
        bits = _reach(base)
        cells = kept(_directory(rows, base, limit), "directory")
        out.append((bits, cells))
        if cells.where("depth is null").isEmpty():
            return out
        open_ = cells.where("depth is null").select("cell")
        rows, base = kept(rows.withColumn("cell", _prefix(bits)).join(open_, "cell", "left_semi").drop("cell"), "keys"), bits


def _placed(rows: DataFrame, found: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows (with key) and their bucket's entry (depth, shard, shard_bytes, shard_docs, oversized); rows aren't moved by
    the first round's directory, which has at most 2 ** STEP cells."""
    names = ["depth", "shard", "shard_bytes", "shard_docs", "oversized"]
    for k, (bits, cells) in enumerate(found):
        cells = cells.where("depth is not null").select(F.col("cell").alias(f"cell_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in names))
        cells = F.broadcast(cells) if not k else cells
        rows = rows.join(cells, _prefix(bits) == F.col(f"cell_{k}"), "left").drop(f"cell_{k}")
    every = [F.coalesce(*(F.col(f"{c}_{k}") for k in range(len(found)))).alias(c) for c in names]
    return rows.select(*(c for c in rows.columns if not any(c == f"{n}_{k}" for n in names for k in range(len(found)))), *every)


def assign(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, depth (bits of the shard), shard (those bits), shard_bytes, shard_docs, oversized of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key(F.col(id_col)).alias("key"))
    out = _placed(rows, directory(docs, limit, id_col))
    return out.select("doc_id", "n_bytes", F.col("depth").cast("int"), "shard", "shard_bytes", "shard_docs", "oversized")


def write(docs: DataFrame, path: str | None = None, limit: int = SHARD_BYTES, id_col: str = "doc_id") -> str:
    """Write docs under path, a folder for each shard (shard=b and its bits), and return the path.

    Texts move once, to at least as many tasks as there are shards. Each task has an equal part of the range of keys, and
    a shard goes to the task in whose part it begins: keys are uniform, so a task writes about its part of all bytes and
    a shard more at most. A shard that is oversized (rows of one id) is dealt over as many tasks as it has limits."""
    path = path or fresh(docs.sparkSession, "shards")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.struct("*")).alias("salt"), key(F.col(id_col)).alias("key"))
    found = directory(docs, limit, id_col)
    rows = _placed(rows, found)
    n_shards = sum(cells.where("depth is not null").select("depth", "shard").distinct().count() for _, cells in found)
    bits = F.when(F.col("depth") > 0, F.lpad(F.bin("shard"), F.col("depth"), F.lit("0"))).otherwise(F.lit(""))
    part = F.when(F.col("oversized"), F.pmod("salt", F.ceil(F.col("shard_bytes") / limit))).otherwise(F.lit(0).cast("long"))
    n = max(parts(docs.sparkSession), n_shards)
    begin = F.expr(f"shiftright(shiftleft(shard, {BITS} - depth), {BITS // 2})")
    task = F.pmod(F.shiftright(begin * n, BITS // 2) + part, F.lit(n)).cast("int")
    rows = rows.select("row", F.concat(F.lit("b"), bits).alias("shard"), task.alias("task")).repartitionById(n, "task")
    rows.select("row", "shard").write.partitionBy("shard").parquet(path)
    return path


def read(docs: DataFrame, path: str) -> DataFrame:
    """Rows of the shards that write() made of docs: row (the document), depth, shard."""
    rows = docs.sparkSession.read.schema(docs.select(F.struct("*").alias("row")).schema.add("shard", "string")).parquet(path)
    bits = F.substring("shard", 2, BITS)
    return rows.select("row", F.length(bits).alias("depth"), F.coalesce(F.conv(bits, 2, 10).cast("long"), F.lit(0).cast("long")).alias("shard"))


def write_and_measure(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id") -> DataFrame:
    """The columns of assign(), all of them read from the shards that were written: bytes and documents are those that
    the files hold."""
    rows = read(docs, write(docs, None, limit, id_col))
    rows = rows.select(F.col(f"row.{id_col}").alias("doc_id"), F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"), "depth", "shard")
    rows = kept(rows, "placed")
    sums = rows.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    return rows.join(sums, ["depth", "shard"]).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))
