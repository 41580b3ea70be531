"""Recompression of word sequences: equal passages get equal symbols inside, wherever they stand.

Rounds of two steps name what stands next to each other. A run of one symbol becomes a symbol for (symbol, length); then every
symbol is a left or a right one by a bit of its name, and a left one followed by a right one becomes a symbol for the pair.
Names are 64-bit hashes of what they stand for, so they are global without a table: any task of any machine gives the same
name to the same words, and a round needs no exchange.

Each symbol carries the context [c0, c1): the words that alone decide that it appears there. Words in a context give the same
symbol in any text, so the symbols whose context lies in a window are a function of the window's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import kernels as K

_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A35625E0C5F3B1), np.uint64(0xC2B2AE3D27D4EB4F)
_FAR = 1 << 40


class Symbols:
    """Symbols of a run of texts: name, words [start, end), context [c0, c1), and row."""

    __slots__ = ("c0", "c1", "end", "name", "row", "start")

    def __init__(self, words: np.ndarray, row: np.ndarray):
        self.name, self.row = words, row
        self.start = np.arange(len(words), dtype=np.int64)
        self.end = self.start + 1
        self.c0, self.c1 = self.start.copy(), self.end.copy()

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Each symbol's previous context start and next context end; at a text's edge, none is enough."""
        before, after = np.full(len(self.name), -_FAR), np.full(len(self.name), _FAR)
        near = self.row[1:] == self.row[:-1]
        before[1:][near] = self.c0[:-1][near]
        after[:-1][near] = self.c1[1:][near]
        return before, after

    def _take(self, head: np.ndarray, last: np.ndarray, name: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> None:
        self.start, self.end, self.row, self.name, self.c0, self.c1 = self.start[head], self.end[last], self.row[head], name, c0, c1

    def runs(self) -> None:
        """Name runs of equal symbols. That a symbol is no longer run is known only with its neighbours."""
        n = len(self.name)
        before, after = self._neighbours()
        cut = np.ones(n, bool)
        cut[1:] = (self.name[1:] != self.name[:-1]) | (self.row[1:] != self.row[:-1])
        head = np.flatnonzero(cut)
        last = np.append(head[1:], n) - 1
        length = (last - head + 1).astype(np.uint64)
        name = np.where(length > 1, K.mix(self.name[head] * _A + length), self.name[head])
        self._take(head, last, name, np.minimum(before[head], self.c0[head]), np.maximum(after[last], self.c1[last]))

    def pairs(self, seed: int) -> None:
        """Name pairs of a left and a right symbol. A pair is known by itself; a single symbol with the side of the neighbour it could pair with."""
        n = len(self.name)
        before, after = self._neighbours()
        right = (K.mix(self.name + K.mix(np.array([seed + 1], np.uint64))) & np.uint64(1)).astype(bool)
        joined = np.zeros(n, bool)  # with the next
        joined[:-1] = ~right[:-1] & right[1:] & (self.row[1:] == self.row[:-1])
        head = np.ones(n, bool)
        head[1:] = ~joined[:-1]
        head = np.flatnonzero(head)
        pair = joined[head]
        last = head + pair
        name = np.where(pair, K.mix(self.name[head] * _A + self.name[last] * _B + np.uint64(seed)), self.name[head])
        c0 = np.where(pair | ~right[head], self.c0[head], np.minimum(before[head], self.c0[head]))
        c1 = np.where(pair | right[head], self.c1[last], np.maximum(after[last], self.c1[last]))
        self._take(head, last, name, np.minimum(c0, self.c0[last]), np.maximum(c1, self.c1[head]))


def levels(words: np.ndarray, row: np.ndarray, rounds: int) -> Iterator[Symbols]:
    """The symbols after each round. They are one object that the next round changes: copy what is to stay."""
    s = Symbols(words, row)
    for r in range(rounds):
        if len(s.name):
            s.runs()
            s.pairs(r)
        yield s


def anchors(s: Symbols, first: np.ndarray, width: int) -> np.ndarray:
    """For each word, the symbol that stands for the window of `width` words from there, or -1.

    Of the symbols whose context lies in the window, that of the least name is taken, the leftmost of equal ones: equal windows
    choose equal symbols at equal places. Without one, or where the window leaves its text, -1.
    """
    n = int(first[-1])
    best = np.full(n, -1)
    lo = np.maximum(s.c1 - width, 0)  # window starts from which the context is inside
    ok = (s.c0 >= 0) & (s.c1 < _FAR) & (s.c1 - s.c0 <= width) & (s.c0 >= lo)
    ids = np.flatnonzero(ok)
    if not len(ids) or n < width:
        return best
    order = ids[np.argsort(K.mix(s.name[ids] ^ _C), kind="stable")]  # least first, then leftmost
    rank = np.full(len(s.name), len(order))
    rank[order] = np.arange(len(order))
    # least rank over the symbols of each window: sweep by offset from the window's first whole context
    value = np.full(n, len(order))
    span = np.maximum(s.c0[ids] - lo[ids] + 1, 0)
    for d in range(int(span.max()) if len(span) else 0):
        some = ids[span > d]
        np.minimum.at(value, lo[some] + d, rank[some])
    found = value < len(order)
    best[found] = order[value[found]]
    inside = np.zeros(n, bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            inside[a : b - width + 1] = True
    best[~inside] = -1
    return best


def contexts(words: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Hashes of the words in each [c0, c1)."""
    power, inverse = K.powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return K.mix((total[c1] - total[c0]) * inverse[c0] ^ (c1 - c0).astype(np.uint64))
