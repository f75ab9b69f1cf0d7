"""Quality rules: counts of each text, and lines that too many documents of one host share.

Cross-document line frequency: lines are normalised (ASCII letters made small, words joined by one space) and
hashed; for each host the distinct documents that hold a line are counted; lines above the limit are removed; a
document that loses too much is rejected. Documents are told apart by their id alone: whether some are copies of each
other is for near-duplicate removal to say, not for this rule.

Defined results: a null or empty text has no words, fails the base rules and is not kept; null hosts are one host;
a row repeated in the input is judged as often as it stands there and counts once as a document (by its id);
rows of a null id count as one document; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .skew import spread_join
from .store import free_name, kept, long_id

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line that has a word is boilerplate of its host if more documents than this hold it.
LINE_DOCS = 100
#: A document is depleted if its boilerplate lines hold more than this share of its words.
DEPLETED_PERCENT = 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which items have an equal earlier item; keys of different texts differ."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    return out


def _lines(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of every text (empty ones among them), and each text's first line."""
    breaks = np.flatnonzero(block.data == 0x0A)
    start = np.sort(np.concatenate([block.at[:-1], breaks + 1]), kind="stable")
    text = np.concatenate([np.arange(len(block.at) - 1), np.searchsorted(block.at, breaks, "right") - 1])
    text.sort(kind="stable")
    at = np.searchsorted(text, np.arange(len(block.at)))
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = at[1:] - 1
    end[last] = block.at[1:]
    return start, end, at


def _count(block: W.Block) -> list[np.ndarray]:
    found = W.words(block)
    n_words = np.diff(found.at)
    inside = W.CLASSES["space"][block.data]
    chars = W.per_text(inside & ((block.data & 0xC0) != 0x80), block.at)
    symbols = W.per_text(_SYMBOLS[block.data], block.at)
    start, end, at = _lines(block)
    first = np.searchsorted(found.start, start)
    full = np.searchsorted(found.start, end) > first
    key = W.spans_hash(block.data, start, end) ^ W.mix(W.owner(at).astype(W.U64), 1)
    dup = np.zeros(len(start), bool)
    dup[full] = _repeats(key[full])
    begin, h = W.windows(found, 3)
    h = h ^ W.mix((np.searchsorted(found.at, begin, "right") - 1).astype(W.U64), 2)
    again = _repeats(h)
    again = np.isin(h, h[again])
    edge = np.zeros(len(found.hash) + 1, np.int64)
    np.add.at(edge, begin[again], 1)
    np.add.at(edge, begin[again] + 3, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return [n_words, chars, symbols, W.per_text(dup, at), W.per_text(covered, found.at)]


def _line_list(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct line of a text that has a word, words of all its places there, and each text's first one."""
    found = W.words(block, lower=True)
    start, end, at = _lines(block)
    lo, hi = np.searchsorted(found.start, start), np.searchsorted(found.start, end)
    use = hi > lo
    h, row, n = W.range_hash(found, lo[use], hi[use]), W.owner(at)[use], (hi - lo)[use]
    order = np.lexsort((h, row))
    h, row, n = h[order], row[order], n[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new].view(np.int64), np.add.reduceat(n, new) if len(h) else n, np.searchsorted(row[new], np.arange(len(block.at)))


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for block in W.blocks(batch.column(names.index("text"))):
            columns = [pa.array(c.astype(np.int64)) for c in _count(block)]
            line, n, at = _line_list(block)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(np.int64))) for x in (line, n)]
            rest = [batch.column(k).slice(block.first, len(block.at) - 1) for k, name in enumerate(names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *columns, *lists], names=[*(n for n in names if n != "text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line", "line_words"])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def read_texts(docs: DataFrame, id_col: str = "doc_id", host_col: str | None = "source") -> DataFrame:
    """One row for each row of docs, from one pass over its whole text: its id, host (by hash; null is one host), n_words
    and four counts, and the text's distinct lines: line (hashes) and line_words (words of all places of each)."""
    host = F.xxhash64(F.col(host_col).cast("string")) if host_col else F.lit(0).cast("long")
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), host.alias("host"), "text")
    return rows.mapInArrow(_read_task, f"doc_id long, host long, {_COUNTS}, line array<long>, line_words array<long>")


def text_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: its id, n_words and the four counts of its whole text, and base_failed."""
    counted = read_texts(docs, id_col, None).drop("host", "line", "line_words")
    return counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def line_table(texts: DataFrame) -> DataFrame:
    """doc_id, host, line, line_words of every distinct line of every row of read_texts()."""
    rows = texts.select("doc_id", "host", F.explode(F.arrays_zip("line", "line_words")).alias("l"))
    return rows.select("doc_id", "host", "l.line", "l.line_words")


def frequent_lines(lines: DataFrame, max_docs: int = LINE_DOCS) -> DataFrame:
    """host, line, n_docs of the lines that more distinct documents of the host hold than max_docs.

    Rows of one id are one document. Each step sums before its shuffle, so no task gathers all rows of a common line."""
    once = lines.groupBy("host", "line", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)


def _lost(texts: DataFrame, max_docs: int) -> DataFrame:
    """doc_id, host, line, w: every document's lines above the limit, and how many words they hold there. A line that
    any share of all documents holds is dealt over all partitions."""
    lines = line_table(texts)
    common = kept(frequent_lines(lines, max_docs), "common_lines")
    found = spread_join(lines, common.select("host", "line"), ["host", "line"], common.withColumnRenamed("n_docs", "n"))
    return found.groupBy("doc_id", "host", "line").agg(F.max("line_words").alias("w"))


def _depleted(lost: Column, n_words: Column) -> Column:
    return 100 * lost > DEPLETED_PERCENT * n_words


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", max_docs: int = LINE_DOCS) -> DataFrame:
    """text_counts with n_line_words (words in lines above the limit) and kept (neither base_failed nor depleted)."""
    texts = kept(read_texts(docs, id_col, host_col), "texts")
    lost = _lost(texts, max_docs).groupBy(F.col("doc_id").alias("lost_id")).agg(F.sum("w").alias("n_line_words"))
    out = texts.drop("host", "line", "line_words").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    out = out.join(lost, F.col("doc_id") == F.col("lost_id"), "left").drop("lost_id")
    out = out.withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    return out.withColumn("kept", ~F.col("base_failed") & ~_depleted(F.col("n_line_words"), F.col("n_words")))


def _clean_task(names: list[str], passes: str) -> Callable:
    """Texts without the lines whose hashes stand in the last column, and a column more: whether the text passes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch.column(names.index("text")), batch.column(len(names)).to_pylist()
            out, passed = text.to_pylist(), []
            for block in W.blocks(text):
                n_words, _, _, _, repeated = _count(block)
                found = W.words(block, lower=True)
                start, end, at = _lines(block)
                lo, hi = np.searchsorted(found.start, start), np.searchsorted(found.start, end)
                for k in range(len(n_words)):
                    row, lost = block.first + k, 0
                    if gone[row]:
                        a, b = at[k], at[k + 1]
                        drop = (hi[a:b] > lo[a:b]) & np.isin(W.range_hash(found, lo[a:b], hi[a:b]).view(np.int64), gone[row])
                        lost = int((hi[a:b] - lo[a:b])[drop].sum())
                        out[row] = b"\n".join(block.data[x:y].tobytes() for x, y, d in zip(start[a:b], end[a:b], drop, strict=True) if not d).decode()
                    passed.append(bool(n_words[k] >= MIN_WORDS and 100 * repeated[k] <= MAX_REPEAT_PERCENT * n_words[k] and 100 * lost <= DEPLETED_PERCENT * n_words[k]))
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(passed, pa.bool_())], names=[*names, passes])

    return task


def clean(docs: DataFrame, host_col: str = "source", max_docs: int = LINE_DOCS) -> DataFrame:
    """The rows of docs (all columns) that pass, without the lines above the limit; n_chars follows the text."""
    lost = _lost(kept(read_texts(docs, "doc_id", host_col), "texts"), max_docs)
    names, id_, lines, passes = docs.columns, free_name(docs, "id"), free_name(docs, "lines"), free_name(docs, "passes")
    lost = lost.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line").alias(lines))
    marked = docs.join(lost, docs["doc_id"] == F.col(id_), "left").select(*(docs[c] for c in names), lines)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = marked.mapInArrow(_clean_task(names, passes), f"{schema}, `{passes}` boolean").where(F.col(passes)).drop(passes)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
