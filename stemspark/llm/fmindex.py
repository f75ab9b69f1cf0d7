"""A full-text index of a shard's words: suffix order, wavelet matrix, and sampled places, in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling; only suffixes that aren't told apart yet are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    key = symbols[order]
    first = np.r_[True, key[1:] != key[:-1]]
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    length = 1
    open_ = np.flatnonzero(~(first & np.r_[first[1:], True]))  # rows of groups of several
    while len(open_):
        at = order[open_]
        key = rank[at].astype(np.int64) * (n + 1) + rank[np.minimum(at + length, n)] + 1
        by = np.argsort(key, kind="stable")
        order[open_] = at[by]
        key = key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        open_ = open_[~(new & np.r_[new[1:], True])]
        length *= 2
    return order


class WaveletMatrix:
    """Symbols below 2**levels by their bits, each level with counts of the ones before each 64 places."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.zeros, self.bits, self.ones = len(symbols), levels, [], [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(bool)
            words = np.zeros((self.n + 64) // 64 * 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words[: len(packed)] = packed
            words = words.view(U64)
            self.bits.append(words)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]])
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _before(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place on the k-th level."""
        word = at >> 6
        part = self.bits[k][word] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
        return self.ones[k][word] + np.bitwise_count(part).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first = np.zeros_like(at)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            a, b = self._before(k, first), self._before(k, at)
            first = np.where(one, self.zeros[k] + a, first - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return at - first

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol, first, here = np.zeros_like(at), np.zeros_like(at), at
        for k in range(self.levels):
            b = self._before(k, here)
            one = self._before(k, here + 1) > b
            a = self._before(k, first)
            symbol = symbol << 1 | one
            first = np.where(one, self.zeros[k] + a, first - a)
            here = np.where(one, self.zeros[k] + b, here - b)
        return symbol, here - first


class FMIndex:
    """Counts and places of phrases in one text of symbols 1 and above; 0 is kept for its end."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        text = np.append(symbols, 0)
        order = suffix_order(text)
        last = text[order - 1]
        self.n, self.sample = len(text), sample
        counts = np.bincount(text)
        self.less = np.r_[0, np.cumsum(counts)]
        self.tree = WaveletMatrix(last, max(1, int(len(counts) - 1).bit_length()))
        kept = order % sample == 0
        self.marks = kept
        self.before = np.r_[0, np.cumsum(kept)]
        self.places = order[kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that begin with each phrase (rows of symbols): first, and the one after the last."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            c = phrases[live, column]
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows start: steps back to the next sampled place."""
        out, at, live = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(live):
            there = self.marks[at[live]]
            hit = live[there]
            out[hit] = self.places[self.before[at[hit]]] + steps
            live = live[~there]
            if len(live):
                c, r = self.tree.access(at[live])
                at[live] = self.less[c] + r
                steps += 1
        return out
