"""Vectorised pre-tokenisation and per-word memos for byte-pair encoders.

A batch of texts is one array of code points. Character classes come from a table,
word borders from a few comparisons of neighbours, and the words' hashes are
looked up in a memo, so only words not met before are encoded one by one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .common import U64, mix64, span_hashes

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
# White space of the Unicode standard, and the contractions both patterns split off.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_classes: np.ndarray | None = None
_codes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point; UNKNOWN where the Unicode data names no character."""
    global _classes
    if _classes is None:
        out = np.full(0x110000, OTHER, np.uint8)
        out[0x32400:0xE0000] = out[0xE0200:0xF0000] = UNKNOWN
        for a, b in ((0, 0xE000), (0xF900, 0x32400), (0xE0000, 0xE0200)):
            cat = np.array(list(map(unicodedata.category, map(chr, range(a, b)))))
            lead = cat.astype("U1")
            out[a:b] = np.select([lead == "L", lead == "N", cat == "Cn"], [LETTER, NUMBER, UNKNOWN], OTHER)
        out[WHITE] = SPACE
        _classes = out
    return _classes


def code_hashes() -> np.ndarray:
    global _codes
    if _codes is None:
        _codes = mix64(np.arange(1, 0x110001, dtype=U64)) | U64(1)
    return _codes


class Batch:
    """Code points of texts, each followed by a line break that belongs to no word."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts) + "\n"
        self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.kind = classes()[self.cp]
        self.kind[self.at[1:] - 1] = UNKNOWN
        self.known = not (np.bincount(self.kind, minlength=5)[UNKNOWN] > len(texts))

    def unknown_texts(self) -> np.ndarray:
        """Texts with a character of no class."""
        n = np.add.reduceat((self.kind == UNKNOWN).astype(np.int64), self.at[:-1])
        return np.flatnonzero(n > 1)

    def _contractions(self, start: np.ndarray) -> None:
        cp, kind = self.cp, self.kind
        quote = np.flatnonzero((cp == 39) & start)
        quote = quote[quote + 1 < len(cp)]
        done = np.zeros(len(quote), bool)
        for c in CONTRACTIONS:
            ok = ~done & (quote + len(c) < len(cp))
            for k, ch in enumerate(c):
                ok &= cp[np.minimum(quote + 1 + k, len(cp) - 1)] == ord(ch)
            q = quote[ok]
            start[q + 1] = False
            rest = q + 1 + len(c)
            start[rest[kind[rest] == LETTER]] = True
            done |= ok

    def space_prefixed(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the pattern that keeps white space, one blank in front of a word included."""
        kind, cp, n = self.kind, self.cp, len(self.cp)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start[self.at[:-1]] = True
        # the last white space of a run that something follows stands alone, or goes with what follows
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != UNKNOWN))
        start[last] = True
        blank = last[cp[last] == 32]
        start[blank + 1] = False
        self._contractions(start)
        return self._spans(start, kind != UNKNOWN)

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the pattern that drops white space and takes every digit by itself."""
        kind, n = self.kind, len(self.cp)
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start[self.at[:-1]] = True
        self._contractions(start)
        return self._spans(start, (kind != UNKNOWN) & (kind != SPACE))

    def _spans(self, start, inside):
        start &= inside
        starts = np.flatnonzero(start)
        edge = start.copy()
        edge[1:] |= inside[:-1] & ~inside[1:]
        edges = np.append(np.flatnonzero(edge), len(edge))
        ends = edges[np.searchsorted(edges, starts, "right")]
        return starts, ends


class Memo:
    """Values of words by hash: for each word a run of numbers in one flat array.

    ``encode(words) -> (numbers, sizes)`` supplies those of new words. When more
    than ``limit`` words are held, the memo starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 3_000_000, kind=np.uint16):
        self.encode, self.limit, self.kind = encode, limit, kind
        self._clear()

    def _clear(self):
        self.keys, self.slot = np.empty(0, U64), np.empty(0, np.int64)
        self.flat, self.begin, self.size = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int32)

    def find(self, batch: Batch, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of every word."""
        if not len(starts):
            return np.empty(0, np.int64)
        if len(self.keys) > self.limit:
            self._clear()
        h = span_hashes(code_hashes()[batch.cp], starts, ends)
        order = np.argsort(h)
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(new)
        unique, first = s[at], order[at]
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == unique
        miss = np.flatnonzero(~known)
        entry = np.empty(len(unique), np.int64)
        entry[known] = self.slot[place[known]]
        if len(miss):
            a, b = starts[first[miss]].tolist(), ends[first[miss]].tolist()
            text = batch.text
            numbers, sizes = self.encode([text[i:j] for i, j in zip(a, b, strict=True)])
            fresh = np.arange(len(self.size), len(self.size) + len(miss))
            entry[miss] = fresh
            self.begin = np.concatenate([self.begin, len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]])])
            self.size = np.concatenate([self.size, sizes.astype(np.int32)])
            self.flat = np.concatenate([self.flat, numbers.astype(self.kind)])
            self.keys = np.insert(self.keys, place[miss], unique[miss])
            self.slot = np.insert(self.slot, place[miss], fresh)
        out = np.empty(len(h), np.int64)
        out[order] = np.repeat(entry, np.diff(np.append(at, len(s))))
        return out


def ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[begin:begin+size], one after another."""
    end = np.cumsum(size, dtype=np.int64)
    if not len(end):
        return flat[:0]
    return flat[np.repeat(begin - (end - size), size) + np.arange(end[-1])]
