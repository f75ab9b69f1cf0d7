"""Words, lines and hashes of whole texts, computed on Arrow's text buffers with numpy.

Every class of word that the operators use is defined on ASCII bytes, so UTF-8 texts are cut on bytes.
A word's hash is a polynomial over a random table of bytes (arithmetic modulo 2**64, read off one running
sum), a window's hash is a polynomial over the hashes of its words; both end in a mixing step. Equal words
have equal hashes in every task, whatever the block they are read in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Bytes that belong to words: all but ASCII white space; ASCII digits, small letters and all beyond ASCII.
CLASSES = {"space": _SPACE, "alnum": _ALNUM}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all others."""
    x = x ^ U64(seed)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@lru_cache(8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    up, down = _powers(base, max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1))
    return up[:n], down[:n]


BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D), 0x5851F42D4C957F2D)


class Block(NamedTuple):
    """Whole texts of some rows: row numbers, all bytes, and where each text starts (one more than texts)."""

    first: int
    data: np.ndarray
    at: np.ndarray


class Words(NamedTuple):
    """Words of a block: first byte and the byte after the last, hash, and each text's first word (one more)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Runs of rows of about `limit` bytes; a longer text is a block of its own. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "") if column.null_count else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def pieces(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which `inside` holds, cut at the starts of texts: starts, ends, first run of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    cut = at[(at >= 0) & (at <= len(data))]
    before[cut] = False  # a text's first byte follows nothing
    start = np.flatnonzero(inside & ~before[:-1])
    edge = after.copy()
    edge[cut] = False
    end = np.flatnonzero(inside & ~edge[1:]) + 1
    return start, end, np.searchsorted(start, at)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, for each pair."""
    up, down = powers(BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def words(block: Block, kind: str = "space", lower: bool = False) -> Words:
    """Words of every text of a block, whole texts."""
    data = LOWER[block.data] if lower else block.data
    start, end, at = pieces(data, block.at, CLASSES[kind][data])
    return Words(start, end, spans_hash(data, start, end), at)


def windows(found: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start (a word's number in the block) and hash of each run of `size` words inside one text."""
    n = len(found.hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = powers(WORD_BASE, n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(mix(found.hash, seed) * up[:n], out=total[1:])
    fits = np.ones(n - size + 1, bool)
    ends = found.at[1:]
    for back in range(1, size):  # windows that would run over a text's end
        past = ends - back
        past = past[(past >= 0) & (past < len(fits)) & (past >= found.at[:-1])]
        fits[past] = False
    start = np.flatnonzero(fits)
    return start, mix((total[start + size] - total[start]) * down[start], size)


def range_hash(found: Words, lo: np.ndarray, hi: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the words lo to hi (excluded), for each pair."""
    n = len(found.hash)
    up, down = powers(WORD_BASE, n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(mix(found.hash, seed) * up[:n], out=total[1:])
    return mix((total[hi] - total[lo]) * down[np.minimum(lo, n)] + (hi - lo).astype(U64))


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of `values` over each text's range."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def owner(at: np.ndarray) -> np.ndarray:
    """The text (its number in the block) of each item of a list that `at` cuts."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
