"""Benchmark decontamination: each shard of training texts gets an FM-index, in which the test phrases are searched.

A shard is a run of whole texts of some SHARD_WORDS words that a task holds; a longer text is a shard of its own.
Its words are symbols of one text with a mark between documents. The windows of the benchmark's items are searched
backwards through the ranks of the wavelet matrix, all at once; their occurrences are located from sampled places of
the suffix order, and the words they cover are merged into spans.

The benchmark is a stated set of phrases: its windows are searched in blocks of PHRASES, each of a bounded size, so
that no task holds more of it at once.

Defined results: a null or blank text has no words and no hit; a null item or one without words has no window;
repeated items of one item_id count once; rows of one doc_id are judged each by itself; null ids are kept; empty
tables give an empty table or no hits; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .fmindex import FMIndex
from .store import kept

WINDOW = 13
#: A document is contaminated if one of so many of its words, or more, is in a hit.
SHARE = 20
SHARD_WORDS = 1_000_000
PHRASES = 200_000
HIT = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _phrase_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, rows = batch.column(0), []
        for block in W.blocks(batch.column(1)):
            found = W.words(block, "alnum", lower=True)
            for k in range(len(block.at) - 1):
                h = found.hash[found.at[k] : found.at[k + 1]]
                item = items[block.first + k].as_py()
                rows += [(item, h[a : a + WINDOW].tobytes()) for a in range(max(1, len(h) - WINDOW + 1)) if len(h)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "phrase"])


def phrases(benchmark: DataFrame) -> DataFrame:
    """item, phrase (hashes of its words) of every window of every item, once each."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), "text")
    return rows.mapInArrow(_phrase_task, "item string, phrase binary").distinct()


class _Search:
    """A block of phrases, by length, and the items of each."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in sorted({len(p) for p, _ in rows}):
            some = [(p, i) for p, i in rows if len(p) == size]
            self.by_length[size // 8] = np.frombuffer(b"".join(p for p, _ in some), W.U64).reshape(len(some), -1), [i for _, i in some]

    def shard(self, hashes: list[np.ndarray]) -> tuple[list[np.ndarray], list[set[str]]]:
        """For each document of a shard (hashes of its words): which words are hit, and the items that hit it."""
        size = np.array([len(h) for h in hashes], np.int64)
        start = np.cumsum(size + 1) - size - 1
        flat = np.concatenate(hashes) if hashes else np.zeros(0, W.U64)
        vocabulary, symbol = np.unique(flat, return_inverse=True)
        text = np.ones(len(flat) + len(hashes), np.int64)  # 1 stands between documents
        text[np.arange(len(flat)) + np.repeat(np.arange(len(hashes)), size)] = symbol + 2
        edge, items = np.zeros(len(text) + 1, np.int64), [set() for _ in hashes]
        index = None
        for length, (rows, owners) in self.by_length.items():
            if not len(vocabulary):
                break
            at = np.minimum(np.searchsorted(vocabulary, rows), len(vocabulary) - 1)
            there = np.flatnonzero((vocabulary[at] == rows).all(1))
            if not len(there):
                continue
            index = index or FMIndex(text)
            lo, hi = index.ranges(at[there] + 2)
            n = hi - lo
            if not n.any():
                continue
            which = np.repeat(there, n)
            found = index.locate(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
            np.add.at(edge, found, 1)
            np.add.at(edge, found + length, -1)
            doc = np.searchsorted(start, found, "right") - 1
            for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                items[d].update(owners[p])
        hit = np.cumsum(edge)[:-1] > 0
        return [hit[a : a + b] for a, b in zip(start.tolist(), size.tolist(), strict=True)], items


_SCHEMA = "doc_id long, n_words long, spans array<struct<start: int, end: int>>, items array<string>"


def _search_task(rows: list[tuple[bytes, list[str]]]) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(rows)
        ids: list = []
        texts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            hits, items = search.shard(texts)
            spans = []
            for hit in hits:
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(HIT)), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "spans", "items"],
            )

        for batch in batches:
            for block in W.blocks(batch.column(1)):
                found = W.words(block, "alnum", lower=True)
                for k in range(len(block.at) - 1):
                    h = found.hash[found.at[k] : found.at[k + 1]]
                    if held and held + len(h) > SHARD_WORDS:
                        yield flush()
                        ids, texts, held = [], [], 0
                    ids.append(batch.column(0)[block.first + k].as_py())
                    texts.append(h)
                    held += len(h)
        if ids:
            yield flush()

    return task


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (words that windows cover, merged; end excluded) and items of each row of docs."""
    spark = docs.sparkSession
    found = phrases(benchmark).groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = kept(found, "phrases")
    blocks = max(1, -(-found.count() // PHRASES))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if blocks == 1:
        block = [(bytes(r.phrase), r["items"]) for r in found.collect()]  # at most PHRASES rows
        return rows.mapInArrow(_search_task(block), _SCHEMA)
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    out = []
    for k in range(blocks):
        some = found.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k)
        block = [(bytes(r.phrase), r["items"]) for r in some.toLocalIterator()]
        out.append(kept(rows.select("row", "text").mapInArrow(_search_task(block), _SCHEMA), "hits"))
    all_ = out[0]
    for one in out[1:]:
        all_ = all_.unionByName(one)
    merged = all_.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", _merge("spans").alias("spans"), "items")


def _merge(column: str) -> Column:
    """Spans that touch or overlap made one."""
    item = "struct<start: int, end: int>"
    return F.expr(
        f"aggregate(array_sort({column}), cast(array() as array<{item}>), (a, s) -> if(size(a) > 0 and element_at(a, -1).end >= s.start,"
        f" concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))), concat(a, array(s))))"
    )


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """spans with n_hit, n_items, items_sha256 and contaminated."""
    out = spans(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = out.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
