"""Token ids of whole texts by the tokenizers library, with the ids of text units kept for reuse.

A byte-level BPE encodes each unit of its splitting pattern by itself, so a unit's ids need to be computed once.
Units are found on the bytes with numpy; a piece between spaces that holds an apostrophe or a character other
than ASCII and the letters from U+00C0 to U+024F is one unit, which the library splits itself; a text that holds
white space beyond ASCII or a special token's string goes to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from . import words as W

#: Most units whose ids a worker keeps; beyond it, it starts anew.
CACHE_UNITS = 1_500_000
BLOCK_BYTES = 1 << 20

LETTER, DIGIT, SPACE, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x30:0x3A] = DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
for _lo, _hi in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0xC0), (0xC3, 0xCA)):
    _CLASS[_lo:_hi] = LETTER
#: Bytes that make a piece one unit: the apostrophe, and lead bytes of characters that may be no letters.
_ODD = np.zeros(256, bool)
_ODD[0x27] = True
_ODD[0xC0:] = True
_ODD[0xC3:0xCA] = False


def _printable() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_PRINTABLE = _printable()


class Encoder:
    """Encodes blocks of texts; each text's ids end with end_id if that is given."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told.get("pre_tokenizer") or {}
        self.by_units = (
            told.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
            and told["model"]["type"] == "BPE"
            and not told["model"].get("dropout")
        )
        self.special = [x["content"].encode() for x in told.get("added_tokens", ())]
        self.end_id = end_id
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(0, W.U64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _odd_texts(self, block: W.Block) -> np.ndarray:
        """Texts that must go to the library whole."""
        d = np.concatenate([block.data, np.zeros(2, np.uint8)])
        a, b, c = d[:-2], d[1:-1], d[2:]
        at = (a >= 0x1C) & (a <= 0x1F)
        if (a >= 0xC2).any():
            at |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xC3) & ((b == 0x97) | (b == 0xB7))
            at |= (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            at |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        where = [np.flatnonzero(at)]
        raw = block.data.tobytes()
        for s in self.special:
            k = raw.find(s)
            while k >= 0:
                where.append(np.array([k]))
                k = raw.find(s, k + 1)
        return np.unique(np.searchsorted(block.at, np.concatenate(where), "right") - 1)

    @staticmethod
    def _units(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of units, and whether a unit is a piece that the library must split."""
        d, n = block.data, len(block.data)
        kind = _CLASS[d]
        space = kind == SPACE
        first = np.zeros(n + 1, bool)
        first[block.at] = True
        before_space = np.r_[False, space[:-1]] & ~first[:-1]
        change = np.r_[True, kind[1:] != kind[:-1]] | first[:-1]
        after_blank = np.r_[False, d[:-1] == 0x20] & ~first[:-1]
        next_full = np.r_[~space[1:], False] & ~first[1:]
        start = np.where(space, ~before_space | next_full, change & ~after_blank)
        piece_at = np.flatnonzero(start & (space & next_full & (d == 0x20) | ~space & (before_space | first[:-1]) | space & ~before_space))
        odd = np.flatnonzero(_ODD[d])
        whole = np.zeros(n, bool)
        if len(odd):
            piece = np.unique(np.searchsorted(piece_at, odd, "right") - 1)
            ends = np.append(piece_at, n)[piece + 1]
            inside = np.zeros(n + 1, np.int32)
            np.add.at(inside, piece_at[piece] + 1, 1)
            np.add.at(inside, ends, -1)
            start &= ~(np.cumsum(inside)[:n] > 0)
            whole[piece_at[piece]] = True
        at = np.flatnonzero(start)
        return at, whole[at]

    def _learn(self, block: W.Block, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, whole: np.ndarray) -> None:
        if len(self.key) + len(key) > CACHE_UNITS:
            self._reset()
        raw, tokenize, ids, sizes = block.data.tobytes(), self.tokenizer.model.tokenize, [], []
        for a, b, w in zip(lo.tolist(), hi.tolist(), whole.tolist(), strict=True):
            unit = raw[a:b]
            got = self._plain(unit.decode()) if w else [t.id for t in tokenize(unit.decode("latin-1").translate(_PRINTABLE))]
            sizes.append(len(got))
            ids += got
        size = np.array(sizes, np.int64)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.array(ids, np.uint32)])
        key, at, size = np.concatenate([self.key, key]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(key, kind="stable")
        self.key, self.at, self.size = key[order], at[order], size[order]

    def encode(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, and where each text's ids start (one more than texts)."""
        n = len(block.at) - 1
        if not self.by_units:
            odd = np.arange(n)
        else:
            odd = self._odd_texts(block)
        texts: dict[int, np.ndarray] = {}
        for k in odd.tolist():
            texts[k] = np.array(self._plain(block.data[block.at[k] : block.at[k + 1]].tobytes().decode()), np.uint32)
        sizes, parts = np.zeros(n, np.int64), []
        if len(odd) < n:
            at, whole = self._units(block)
            end = np.append(at[1:], len(block.data))
            text = np.searchsorted(block.at, at, "right") - 1
            if len(odd):
                use = ~np.isin(text, odd)
                at, end, whole, text = at[use], end[use], whole[use], text[use]
            key = W.spans_hash(block.data, at, end)
            unit, where, back = np.unique(key, return_index=True, return_inverse=True)
            if len(self.key) + len(unit) > CACHE_UNITS:
                self._reset()
            place = np.searchsorted(self.key, unit)
            new = np.append(self.key, W.U64(0))[place] != unit
            new |= place == len(self.key)
            if new.any():
                w = where[new]
                self._learn(block, unit[new], at[w], end[w], whole[w])
            found = np.searchsorted(self.key, unit)[back]
            size, source = self.size[found], self.at[found]
            total = np.cumsum(size)
            if len(total):
                ids = self.pool[np.repeat(source - (total - size), size) + np.arange(total[-1])]
                sizes = W.per_text(size, np.searchsorted(text, np.arange(n + 1)))
            else:
                ids = np.zeros(0, np.uint32)
        else:
            ids = np.zeros(0, np.uint32)
        if texts or self.end_id is not None:
            begin = np.cumsum(sizes) - sizes
            for k, x in texts.items():
                sizes[k] = len(x)
            more = int(self.end_id is not None)
            out = np.empty(int(sizes.sum()) + more * n, np.uint32)
            stop = np.cumsum(sizes + more)
            if texts:
                for k in range(n):
                    lo = stop[k] - sizes[k] - more
                    out[lo : lo + sizes[k]] = texts[k] if k in texts else ids[begin[k] : begin[k] + sizes[k]]
            else:
                body = np.ones(len(out), bool)
                body[stop - 1] = False
                out[body] = ids
            if more:
                out[stop - 1] = self.end_id
            ids, sizes = out, sizes + more
        return ids, np.r_[0, np.cumsum(sizes)]


@lru_cache(4)
def encoder(path: str, end_id: int | None = None) -> Encoder:
    """One encoder for each worker, so that the units it has seen serve its later tasks."""
    return Encoder(path, end_id)
