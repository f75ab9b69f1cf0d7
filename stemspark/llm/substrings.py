"""Exact removal of repeated passages, incrementally, by a log-structured index of fingerprints.

A window is WINDOW consecutive words. Each has an anchor: the least hash among its short grams, the leftmost of
equals. Neighbouring windows of one anchor form a group; equal windows have equal anchors. So a passage's windows are
told by one row for some seven of them: the anchor's gram and a digest of all words of the group.

The index is a list of immutable runs. A run holds, sorted and bucketed by gram, one row for each gram of the
documents it covers: the least and greatest group, and the first document; and beside it the groups of the grams
that have several. A batch becomes a run of its own first. Merge-joined on the gram with the runs before it (no
shuffle: all have the same buckets), it tells which grams are shared:

* a gram that is there once holds no repeated window;
* a gram with one group only: every later document repeats the whole group;
* else later documents of a group repeat it, and the first one's windows are looked at singly, with those of other groups of
  that gram, in the batch's texts and in the few older texts that hold one; the first document of each window stays.

Runs are compacted level by level: FAN runs of one level are merge-joined into one of the next.

What is equal is verified on the words: groups and windows are compared by a digest (64 bits, XXH3) of the words' own
bytes beside the 64 bits that brought them together; two words of one hash are still two words.

A gram, group or window that any share of all documents hold is no hot key: sums are made before shuffles, and the
joins back to the rows deal such keys over all partitions (skew.spread_join).

Defined results: a null or blank text has no words; rows with a null id keep all their words; rows of one doc_id
are judged alike, and their equal windows aren't earlier than each other; documents of less than WINDOW words keep
everything; an empty table gives an empty table; other columns don't matter, whatever their names; ids that are no
integers are refused.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .skew import spread_join
from .store import Scratch, drop, fresh, kept, long_id, parts

WINDOW, GRAM = 20, 8
FAN = 2
#: How many batches, in order of doc_id, `dedup` feeds to the index.
BATCHES = 3
_ROW = "gram long, grp long, doc_id long, again boolean"
_LOW = np.uint64(0xFFFFFF)
#: What becomes of a group in a document: all of its places go, all but the first, or the first is looked at.
GONE, LATER, LOOK = 0, 1, 2


def digests(block: W.Block, found: W.Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A digest of the bytes of the words lo to hi (excluded), joined by one space, for each pair."""
    from xxhash import xxh3_64_intdigest

    raw, blank = block.data.tobytes(), np.append(block.data, 0x20)
    odd = np.zeros(len(found.start) + 1, np.int64)  # how many words before are not followed by a single space
    np.cumsum(np.r_[found.start[1:] - found.end[:-1] != 1, True] | (blank[found.end] != 0x20), out=odd[1:])
    plain = odd[hi - 1] == odd[lo]
    spans = zip(found.start[lo].tolist(), found.end[hi - 1].tolist(), plain.tolist(), strict=True)
    return np.array([xxh3_64_intdigest(raw[a:b] if p else b" ".join(raw[a:b].split())) for a, b, p in spans], W.U64).view(np.int64)


def groups(block: W.Block, found: W.Words) -> tuple[np.ndarray, ...]:
    """Groups of windows of a block's texts: gram, digest of all words, text, first and last window's start."""
    none = np.zeros(0, np.int64)
    fits, _ = W.windows(found, WINDOW)
    if not len(fits):
        return none, none, none, none, none
    at, gram = W.windows(found, GRAM)
    key = np.full(len(found.hash), ~W.U64(0))
    key[at] = (gram & ~_LOW) | (at.astype(W.U64) & _LOW)  # 40 bits of hash, then the place: leftmost of equals
    span = 1
    want = WINDOW - GRAM + 1
    while span < want:
        step = min(span, want - span)
        key = np.minimum(key[:-step], key[step:])
        span += step
    low = (key[fits] & _LOW).astype(np.int64)
    anchor = fits + ((low - fits) & int(_LOW))  # blocks may hold more words than 24 bits tell apart
    text = np.searchsorted(found.at, fits, "right") - 1
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    lo, hi = fits[new], np.append(fits[new[1:] - 1], fits[-1])
    every = np.zeros(len(found.hash), W.U64)
    every[at] = gram
    return every[anchor[new]].view(np.int64), digests(block, found, lo, hi + WINDOW), text[new], lo, hi


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first item of each kind, in order, and whether its kind comes again."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    head = np.flatnonzero(new)
    first, again = order[head], np.diff(np.append(head, len(order))) > 1
    back = np.argsort(first, kind="stable")
    return first[back], again[back]


def _row_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(1)):
            gram, grp, text, _, _ = groups(block, W.words(block))
            first, again = _firsts(text, gram, grp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[first]), pa.array(grp[first]), batch.column(0).take(pa.array(text[first] + block.first)), pa.array(again)],
                names=["gram", "grp", "doc_id", "again"],
            )


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for batch in batches:
        zip_ = zstandard.ZstdCompressor(level=3)
        text = [zip_.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()), batch.column(2)], names=["doc_id", "text", "new"])


def _result(words: list[bytes], gone: np.ndarray, as_text: bool) -> tuple[int, int, str]:
    left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
    return len(words), int(gone.sum()), left.decode() if as_text else hashlib.sha256(left).hexdigest()


_DONE = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("out", pa.string())]
_LOOKED = pa.schema([*_DONE, ("text", pa.binary()), ("spans", pa.binary()), ("windows", pa.list_(pa.struct([("h", pa.int64()), ("check", pa.int64()), ("start", pa.int32())])))])


def _marked(texts: pa.Array, marks: list[list[dict] | None]) -> tuple[list[bytes], list[list[dict]]]:
    """For each text: spans of words that are gone for sure (starts, ends), and the windows to look at."""
    spans, windows = [b""] * len(texts), [[] for _ in range(len(texts))]
    for block in W.blocks(texts):
        found = W.words(block)
        _, grp, text, lo, hi = groups(block, found)
        first, _ = _firsts(text, grp)
        later = np.ones(len(grp), bool)
        later[first] = False
        mine = [(k, m["grp"], m["kind"]) for k in range(len(block.at) - 1) for m in marks[block.first + k] or ()]
        of, want, kind = (np.array(c, np.int64) for c in zip(*mine, strict=True)) if mine else (np.zeros(0, np.int64),) * 3
        told = np.full(len(grp), 1 + LOOK, np.int64)
        if len(of):  # both lists in one order: a group's marks stand right before it
            order = np.lexsort((np.r_[kind - LOOK - 1, np.zeros(len(grp), np.int64)], np.r_[want, grp], np.r_[of, text]))
            is_mark = order < len(of)
            new = np.r_[True, (np.r_[want, grp][order][1:] != np.r_[want, grp][order][:-1]) | (np.r_[of, text][order][1:] != np.r_[of, text][order][:-1])]
            head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))  # the least kind of mark of that group
            use = ~is_mark & is_mark[head]
            told[order[use] - len(of)] = kind[order[head[use]]]
        gone = (told == GONE) | (told <= LOOK) & later
        look = np.flatnonzero((told == LOOK) & ~later)
        n = hi[look] - lo[look] + 1
        start = np.repeat(lo[look] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        owner = np.repeat(text[look], n)
        h, check = W.range_hash(found, start, start + WINDOW, 11).view(np.int64), digests(block, found, start, start + WINDOW)
        once, _ = _firsts(owner, h, check)
        twice = np.delete(np.arange(len(start)), once)  # windows that their document holds before
        a, b = np.r_[lo[gone], start[twice]], np.r_[hi[gone] + WINDOW, start[twice] + WINDOW]
        whose = np.r_[text[gone], owner[twice]]
        order = np.argsort(whose, kind="stable")
        cut = np.searchsorted(whose[order], np.arange(len(block.at)))
        pairs = (np.stack([a, b], 1) - found.at[whose][:, None])[order].astype("<i4")
        for k in np.unique(whose).tolist():
            spans[block.first + k] = pairs[cut[k] : cut[k + 1]].tobytes()
        for k, x, y, z in zip(owner[once].tolist(), h[once].tolist(), check[once].tolist(), (start - found.at[owner])[once].tolist(), strict=True):
            windows[block.first + k].append({"h": x, "check": y, "start": z})
    return spans, windows


def _look_task(as_text: bool) -> Callable:
    """Documents with their marks: finished ones (out is set), or text, spans that are gone, and windows to look at."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for wide in batches:
            for lo in range(0, len(wide), 1024):
                batch = wide.slice(lo, 1024)
                doc_ids, packed, new, marks = (c.to_pylist() for c in batch.columns)
                raw = [unzip.decompress(x) for x in packed]
                spans, windows = _marked(pa.array([r if m else b"" for r, m in zip(raw, marks, strict=True)], pa.binary()), marks)
                rows: list[tuple] = []
                for k, doc_id in enumerate(doc_ids):
                    if windows[k]:
                        rows.append((doc_id, None, None, None, packed[k] if new[k] else None, spans[k] if new[k] else None, windows[k]))
                    elif new[k]:
                        words = raw[k].split()
                        rows.append((doc_id, *_result(words, _gone(len(words), spans[k], []), as_text), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_LOOKED)], schema=_LOOKED)

    return task


def _gone(n: int, spans: bytes, starts: list[int]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    a, b = np.frombuffer(spans, "<i4").reshape(-1, 2).T
    s = np.asarray(starts, np.int64)
    np.add.at(edge, np.concatenate([a, s]).astype(np.int64), 1)
    np.add.at(edge, np.concatenate([b, s + WINDOW]).astype(np.int64), -1)
    return np.cumsum(edge)[:n] > 0


def _finish_task(as_text: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, packed, spans, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = unzip.decompress(packed).split()
                rows.append((doc_id, *_result(words, _gone(len(words), spans, starts or []), as_text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_DONE)], schema=pa.schema(_DONE))

    return task


class Run(NamedTuple):
    """An immutable run: its level, the table of its grams (gram, g0, g1, first), and the path of its groups
    (gram, grp, first) of grams that have several."""

    level: int
    grams: str
    groups: str


class Index:
    """Runs of the documents seen so far, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or fresh(spark, "fingerprints")
        self.buckets = parts(spark)
        self.runs: list[Run] = []

    def save(self, grams: DataFrame) -> str:
        """Write the grams of a run, a sorted file for each bucket of grams; returns the table's name."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        writer = grams.write.format("parquet").bucketBy(self.buckets, "gram").sortBy("gram")
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def save_groups(self, groups_: DataFrame) -> str:
        path = f"{self.folder}/groups-{uuid.uuid4().hex}"
        groups_.select("gram", "grp", "first").write.parquet(path)
        return path

    def grams(self, run: Run) -> DataFrame:
        return self.spark.table(run.grams).select("gram", "g0", "g1", "first")

    def groups(self, run: Run) -> DataFrame:
        return self.spark.read.schema("gram long, grp long, first long").parquet(run.groups)

    def merged(self, grams: DataFrame, runs: list[Run]) -> DataFrame:
        """grams (gram, g0, g1, first and others) merge-joined with runs: the same with all that they know, and seen."""
        seen = F.lit(False)
        for k, run in enumerate(runs):
            old = self.grams(run).select("gram", F.col("g0").alias(f"g0_{k}"), F.col("g1").alias(f"g1_{k}"), F.col("first").alias(f"first_{k}"))
            grams = grams.join(old.hint("merge"), "gram", "left")
            seen = seen | F.col(f"g0_{k}").isNotNull()
        own = [c for c in grams.columns if not any(c.endswith(f"_{k}") for k in range(len(runs)))]
        of = {"g0": F.least, "g1": F.greatest, "first": F.least}
        every = [of[c](c, *(f"{c}_{k}" for k in range(len(runs)))).alias(c) if c in of and runs else F.col(c) for c in own]
        return grams.select(*every, seen.alias("seen"))

    def _forget(self, runs: list[Run]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.grams}")
            drop(self.spark, f"{self.folder}/{run.grams}")
            drop(self.spark, run.groups)

    def compact(self) -> None:
        """Merge-join FAN runs of a level into one of the next, and delete them. Of equal groups the first document stays."""
        level = 0
        while any(r.level >= level for r in self.runs):
            same = [r for r in self.runs if r.level == level]
            if len(same) >= FAN:
                sides = [self.grams(r) for r in same]
                grams = sides[0]
                for other in sides[1:]:
                    b = other.select("gram", F.col("g0").alias("b0"), F.col("g1").alias("b1"), F.col("first").alias("b"))
                    grams = grams.join(b.hint("merge"), "gram", "full")
                    grams = grams.select("gram", F.least("g0", "b0").alias("g0"), F.greatest("g1", "b1").alias("g1"), F.least("first", "b").alias("first"))
                name = self.save(grams)
                several = self.spark.table(name).where("g0 <> g1").select("gram")
                every = self.groups(same[0])
                for r in same[1:]:
                    every = every.unionByName(self.groups(r))
                for r in same:  # a gram of one group in a run may have several in all
                    alone = self.grams(r).where("g0 = g1").join(several.hint("merge"), "gram", "left_semi")
                    every = every.unionByName(alone.select("gram", F.col("g0").alias("grp"), "first"))
                path = self.save_groups(every.groupBy("gram", "grp").agg(F.min("first").alias("first")))
                self.runs = [r for r in self.runs if r.level != level] + [Run(level + 1, name, path)]
                self._forget(same)
            level += 1

    def delete(self) -> None:
        """Delete all runs."""
        self._forget(self.runs)
        self.runs = []
        drop(self.spark, self.folder)


def _marks(index: Index, ids: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Add the run of a batch (doc_id, text) to the index; returns doc_id, grp, kind of the groups of its documents that
    aren't simply kept, and of the older documents' groups that are to be looked at."""
    rows = work.kept(ids.mapInArrow(_row_task, _ROW), "rows")
    n = (1 + F.col("again").cast("long")).alias("n")
    own = rows.select("*", n).groupBy("gram").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.min("doc_id").alias("first"), F.sum("n").alias("n"))
    before = list(index.runs)
    name = index.save(own)
    grams = index.spark.table(name).withColumn("mixed", F.col("g0") != F.col("g1"))
    shared = index.merged(grams, before).where("n > 1 or seen")
    shared = work.kept(shared.select("gram", "n", (F.col("g0") == F.col("g1")).alias("lone"), "mixed", "first"), "shared")
    rows = work.kept(spread_join(rows, shared.drop("n"), ["gram"], shared), "candidates")
    late = F.when(F.col("doc_id") > F.col("first"), GONE).otherwise(LATER)
    marks = rows.where("lone and (doc_id > first or again)").select("doc_id", "grp", late.alias("kind"))
    several = rows.where("not lone").select("gram", "grp", "doc_id", "mixed")
    new = several.groupBy("gram", "grp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("mixed").alias("mixed"))
    new = work.kept(new, "new_groups")
    index.runs.append(Run(0, name, index.save_groups(new.where("mixed"))))
    open_ = shared.where("not lone").select("gram")
    every = new.select("gram", "grp", "first", "n", F.lit(False).alias("old"))
    for run in before:
        alone = index.grams(run).where("g0 = g1").join(open_, "gram", "left_semi").select("gram", F.col("g0").alias("grp"), "first")
        old = alone.unionByName(spread_join(index.groups(run), open_, ["gram"]))
        every = every.unionByName(old.select("gram", "grp", "first", F.lit(0).cast("long").alias("n"), F.lit(True).alias("old")))
    every = every.groupBy("gram", "grp").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("old").alias("old"))
    every = work.kept(every, "groups")
    kind = F.when(F.col("doc_id") > F.col("first"), GONE).otherwise(LOOK)
    again = spread_join(several.drop("mixed"), every.drop("n", "old"), ["gram", "grp"], every)
    marks = marks.unionByName(again.select("doc_id", "grp", kind.alias("kind")))
    old = every.where("old").select(F.col("first").alias("doc_id"), "grp", F.lit(LOOK).alias("kind"))
    return marks, old


def dedup_batch(index: Index, docs: DataFrame, history: DataFrame | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the words that stay (out: their SHA-256, or the text) of each row of docs.

    A word goes if a window that covers it starts earlier too: in a document of `history` (those added before, whose
    ids must be smaller) or in docs, by smaller doc_id or earlier start. history is read only for the documents
    whose passages the batch may repeat; an index that has runs isn't enough without it.
    """
    if index.runs and history is None:
        raise ValueError("the index has runs: their documents' texts are needed as history")
    work, has_runs = Scratch(docs.sparkSession, "substrings"), bool(index.runs)
    rows = docs.select(long_id(docs).alias("doc_id"), "text", F.lit(True).alias("new"))
    marks, old = _marks(index, rows.where("doc_id is not null").select("doc_id", "text"), work)
    texts = rows
    if has_runs:
        older = history.select(long_id(history).alias("doc_id"), "text", F.lit(False).alias("new"))
        texts = texts.unionByName(older.join(old.select("doc_id").distinct(), "doc_id", "left_semi"))
        marks = marks.unionByName(old)
    marks = marks.groupBy(F.col("doc_id").alias("marked")).agg(F.collect_list(F.struct("grp", "kind")).alias("marks"))
    packed = texts.mapInArrow(_squeeze, "doc_id long, text binary, new boolean")
    marked = packed.join(marks, F.col("doc_id") == F.col("marked"), "left").select("doc_id", "text", "new", "marks")
    schema = "doc_id long, n_words long, n_removed long, out string, text binary, spans binary, windows array<struct<h: long, check: long, start: int>>"
    looked = kept(marked.mapInArrow(_look_task(as_text), schema), "looked")
    work.drop()
    windows = looked.where("windows is not null").select("doc_id", F.inline("windows"))
    least = windows.groupBy("h", "check").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = kept(least, "windows")
    again = spread_join(windows, least.drop("n"), ["h", "check"], least).where("doc_id > first")
    again = again.groupBy(F.col("doc_id").alias("marked")).agg(F.collect_set("start").alias("starts"))
    open_ = looked.where("text is not null").select("doc_id", "text", "spans")
    open_ = open_.join(again, F.col("doc_id") == F.col("marked"), "left").select("doc_id", "text", "spans", "starts")
    finished = open_.mapInArrow(_finish_task(as_text), "doc_id long, n_words long, n_removed long, out string")
    return looked.where("out is not null").select("doc_id", "n_words", "n_removed", "out").unionByName(finished)


def dedup(docs: DataFrame, as_text: bool = False, batches: int = BATCHES) -> DataFrame:
    """dedup_batch of a table in batches of ascending doc_id, each against the runs of those before it.

    The same rows come out for any number of batches. The index goes when the last batch is done."""
    index = Index(docs.sparkSession)
    id_ = long_id(docs)
    cuts = docs.select(F.percentile_approx(id_, [k / batches for k in range(1, batches)]) if batches > 1 else F.lit(None)).first()[0]
    cuts = sorted(set(cuts or []))
    out = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        here = F.lit(True) if hi is None else id_ <= hi
        here = here & (id_ > lo) if lo is not None else here | id_.isNull()
        done = dedup_batch(index, docs.where(here), docs.where(id_ <= lo) if lo is not None else None, as_text)
        out = done if out is None else out.unionByName(done)
        if hi is not None:
            index.compact()
    index.delete()
    return out
