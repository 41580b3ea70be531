"""Induced sorting of the suffixes of one shard, with common prefixes, in blocks that are kept on disk beyond a bound.

A suffix is of type L if it is greater than the one after it, else S; an S after an L is a seed. Sorted seeds induce the order of all
others: going up, each suffix puts the L before it into the queue of its first symbol; going down, each puts the S before it.
What a queue holds comes out in the order in which it went in, for a symbol's suffixes are put there by ever greater (or ever smaller)
ones. So the queues of all symbols together are a priority queue by (symbol, rank of the rest), and a block of a queue is worked at once.

Each entry carries the length of its common prefix with the entry before it, up to `width`: one more than the least between the two
suffixes that put them there. Seeds are sorted by inducing once from unsorted ones, which sorts the pieces between seeds; equal pieces
get equal names, and the names' own suffixes are ranked by doubling until they cover `width` symbols. Beyond that, order does not matter here.

Arrays and queue blocks beyond HELD bytes go to unnamed files of the task, gone with it; no other task reads them.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Bytes of queue blocks kept in memory, and of a single array; entries worked at once.
HELD, ARRAY, BLOCK = 64 << 20, 64 << 20, 1 << 16
#: Symbols that are compared at once.
WORD = 4
_NONE = 255  # no common prefix seen yet; width is below


def room(n: int, dtype, limit: int | None = None) -> np.ndarray:
    """Zeros in memory, or in an unnamed file if they are many."""
    size = n * np.dtype(dtype).itemsize
    if size <= (ARRAY if limit is None else limit):
        return np.zeros(n, dtype)
    file = tempfile.TemporaryFile()  # noqa: SIM115  the map keeps it
    file.truncate(size)
    return np.memmap(file, dtype=dtype, shape=(n,))


class Spill:
    """Blocks of entries (position, common prefix), in memory up to `held` bytes and in one unnamed file beyond."""

    def __init__(self, held: int):
        self.held, self.used, self.end, self.file = held, 0, 0, None

    def put(self, at: np.ndarray, lcp: np.ndarray):
        size = at.nbytes + lcp.nbytes
        if self.used + size <= self.held:
            self.used += size
            return at, lcp
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.file.seek(self.end)
        self.file.write(at.tobytes() + lcp.tobytes())
        place, self.end = self.end, self.end + size
        return place, len(at), at.dtype

    def get(self, block, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """last: the block is not read again."""
        if len(block) == 2:
            self.used -= (block[0].nbytes + block[1].nbytes) * last
            return block
        place, n, dtype = block
        self.file.seek(place)
        raw = self.file.read(n * (dtype.itemsize + 1))
        return np.frombuffer(raw, dtype, n), np.frombuffer(raw, np.uint8, n, n * dtype.itemsize)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _least(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of lcp[lo..hi] for each pair, by a table of powers of two."""
    span = hi - lo + 1
    power = np.int64(np.log2(span.astype(np.float64)))
    out = np.empty(len(lo), np.uint8)
    level, k = lcp, 0
    while True:
        some = np.flatnonzero(power == k)
        out[some] = np.minimum(level[lo[some]], level[hi[some] - (1 << k) + 1])
        k += 1
        if 1 << k > len(lcp) or not (power >= k).any():
            return out
        level = np.minimum(level[: -(1 << (k - 1))], level[1 << (k - 1) :])


class _Pass:
    """Queues by symbol, and for each the least common prefix since its last entry."""

    def __init__(self, text: np.ndarray, sigma: int, width: int, carry: bool, spill: Spill):
        self.text, self.width, self.carry, self.spill = text, width, carry, spill
        self.queues: list[deque] = [deque() for _ in range(sigma)]
        self.since = np.full(sigma, _NONE, np.uint8)
        self.begun = np.zeros(sigma, bool)

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """The oldest entries of a queue, up to about BLOCK."""
        queue, parts, n = self.queues[symbol], [], 0
        while queue and n < BLOCK:
            parts.append(self.spill.get(queue.popleft()))
            n += len(parts[-1][0])
        return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def put(self, at: np.ndarray, lcp: np.ndarray, low: int, high: int) -> None:
        """For entries in order, the suffixes before them whose first symbol is in [low, high] go into its queue."""
        before = self.text[np.maximum(at, 1) - 1].astype(np.int64)
        index = np.flatnonzero((at > 0) & (before >= low) & (before <= high))
        symbol = before[index]
        order = np.argsort(symbol.astype(np.uint16), kind="stable")
        index, symbol = index[order], symbol[order]
        new = np.ones(len(index), bool)
        new[1:] = symbol[1:] != symbol[:-1]
        head = np.flatnonzero(new)
        shared = np.zeros(len(index), np.uint8)
        if self.carry and len(at):
            up = np.minimum.accumulate(lcp)
            if len(index):
                later = np.flatnonzero(~new)
                if len(later):
                    shared[later] = _least(lcp, index[later - 1] + 1, index[later])
                shared[head] = np.minimum(self.since[symbol[head]], up[index[head]])
                shared = np.minimum(shared.astype(np.int64) + 1, self.width).astype(np.uint8)
                shared[head[~self.begun[symbol[head]]]] = 0
            self.since = np.minimum(self.since, up[-1])
            if len(index):
                down = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(_NONE))
                tail = np.append(head[1:], len(index)) - 1
                self.since[symbol[tail]] = down[index[tail] + 1]
                self.begun[symbol[head]] = True
        found = (at[index] - 1).astype(at.dtype)
        cuts = [*head.tolist(), len(index)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.queues[int(symbol[a])].append(self.spill.put(found[a:b], shared[a:b]))


def words(text: np.ndarray, n: int) -> np.ndarray:
    """At each of n places, four symbols of 16 bits as one word. text goes on for WORD - 1 symbols at least."""
    out = room(n, np.uint64)
    for k in range(WORD):
        out <<= np.uint64(16)
        out |= text[k : k + n]
    return out


def common(word: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, known: np.ndarray | None = None) -> np.ndarray:
    """Symbols, up to width, that the suffixes at a and at b begin with alike, four at a time. Words go on for width places after the text.

    known: how many are known to be alike.
    """
    out = np.full(len(a), width, np.uint8)
    if known is None:
        known = np.zeros(len(a), np.int64)
    rest = np.flatnonzero(known < width)
    a, b = a + known, b + known
    for k in range(0, width, WORD):
        differ = word[a[rest] + k] ^ word[b[rest] + k]
        ended = np.flatnonzero(differ)
        if len(ended):
            x = differ[ended]
            alike = (x < 1 << 48).astype(np.uint8) + (x < 1 << 32) + (x < 1 << 16)
            out[rest[ended]] = np.minimum(alike + k + known[rest[ended]], width)
            rest = rest[differ == 0]
        rest = rest[known[rest] + k + WORD < width]
        if not len(rest):
            break
    return out


def _induce(text: np.ndarray, word: np.ndarray, sigma: int, seeds: np.ndarray, lcp: np.ndarray, width: int, carry: bool, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All suffixes but the last seed, from the greatest down, in blocks: positions, common prefix with the one before (above), are they S."""
    up_spill, down_spill = Spill(held), Spill(held)
    up = _Pass(text, sigma, width, carry, up_spill)
    bounds = np.searchsorted(text[seeds], np.arange(sigma + 1))
    kept: list[list] = [[] for _ in range(sigma)]
    one = lambda a, b: common(word, np.array([a]), np.array([b]), width)[0] if carry else np.uint8(0)
    for symbol in range(sigma):
        last = -1
        while up.queues[symbol]:
            at, c = up.pop(symbol)
            kept[symbol].append(up_spill.put(at, c))
            last = int(at[-1])
            up.put(at, c, symbol, sigma)
        own, c = seeds[bounds[symbol] : bounds[symbol + 1]], lcp[bounds[symbol] : bounds[symbol + 1]].copy()
        if len(own):
            c[0] = one(last, int(own[0])) if last >= 0 else 0
            for i in range(0, len(own), BLOCK):
                up.put(own[i : i + BLOCK], c[i : i + BLOCK], symbol + 1, sigma)
    down = _Pass(text, sigma, width, carry, down_spill)
    for symbol in range(sigma - 1, -1, -1):
        last = -1
        while down.queues[symbol]:
            at, c = down.pop(symbol)
            last = int(at[-1])
            down.put(at, c, 0, symbol)
            yield at, c, True
        link = None
        while kept[symbol]:
            at, c = up_spill.get(kept[symbol].pop())
            first = link if link is not None else (one(last, int(at[-1])) if last >= 0 else np.uint8(0))
            link, at, c = c[0], at[::-1], np.concatenate([[first], c[:0:-1]]).astype(np.uint8)
            down.put(at, c, 0, symbol - 1)
            yield at, c, False
    up_spill.close()
    down_spill.close()


def _ranked(seeds: np.ndarray, name: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of names (in text order), decided by the symbols that their first pieces cover up to width; and how many
    symbols each is known to share with the one before."""
    m, h = len(name), 1
    order = np.argsort(name, kind="stable")
    fresh = np.ones(m, bool)
    fresh[1:] = name[order[1:]] != name[order[:-1]]
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, m))
    rank = np.empty(m, np.int64)  # of equal ones, the place of the first
    rank[order] = np.repeat(head, size)
    open_ = np.zeros(m, bool)
    open_[order] = np.repeat(size > 1, size)
    active = np.flatnonzero(open_)
    shared = np.zeros(m, np.int64)
    while True:
        # equal names cover equally much, so a group is decided as a whole
        after = active + h
        active = active[(after < m) & (seeds[np.minimum(after, m - 1)] - seeds[active] < width)]
        if not len(active):
            order = np.argsort(rank, kind="stable")
            shared[1:][rank[order[1:]] == rank[order[:-1]]] = width
            return order, shared
        pair = rank[active] * np.int64(m) + rank[active + h]
        by = np.argsort(pair)
        sorted_, pair = active[by], pair[by]
        group = rank[sorted_]
        fresh = np.ones(len(by), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(opens)
        begin = np.repeat(first, np.diff(np.append(first, len(by))))
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(by)))
        rank[sorted_] = group + np.repeat(head, size) - begin
        parted = sorted_[head[~opens[head]]]  # from the one before only now, so h names are alike
        shared[rank[parted]] = seeds[parted + h] - seeds[parted]
        active = np.sort(sorted_[np.repeat(size > 1, size)])
        h *= 2


def suffixes(text: np.ndarray, n: int, sigma: int, width: int, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of text[:n] but the last, from the greatest down, ordered by their first `width` symbols at least: blocks of positions,
    and of common prefixes with the one above, up to width. Symbol n - 1 is 0, and width + WORD symbols of room follow it."""
    up = np.empty(n, bool)  # S
    step = text[: n - 1].astype(np.int32) - text[1:n]
    differ = np.flatnonzero(step)
    nearest = np.searchsorted(differ, np.arange(n - 1))
    inside = nearest < len(differ)
    up[:-1] = False
    up[:-1][inside] = step[differ[nearest[inside]]] < 0
    up[-1] = True
    seed = np.zeros(n, bool)
    seed[1:] = up[1:] & ~up[:-1]
    kind = np.int32 if n < 1 << 31 else np.int64
    seeds = np.flatnonzero(seed).astype(kind)
    del step, differ, nearest, inside, up
    by_symbol = seeds[np.argsort(text[seeds], kind="stable")]
    parts = [at[seed[at]] for at, _, s in _induce(text, text, sigma, by_symbol, np.zeros(len(seeds), np.uint8), width, False, held) if s]
    word = words(text, n + width)
    order = np.concatenate([*parts, [n - 1]])[::-1].astype(kind)  # pieces between seeds, least first
    of = np.searchsorted(seeds, order)
    ends = np.append(seeds[1:], n - 1)[of]
    length = ends - order
    name = np.zeros(len(order), np.int64)
    if len(order) > 1:
        short = np.maximum(np.minimum(length[1:], length[:-1]), 0)
        same = length[1:] == length[:-1]
        at = np.flatnonzero(same & (short < width))
        alike = np.zeros(len(order) - 1, bool)
        alike[at] = common(word, order[1:][at], order[:-1][at], width) > short[at]
        long = np.flatnonzero(same & (short >= width))  # pieces beyond width differ where their first width symbols do
        alike[long] = common(word, order[1:][long], order[:-1][long], width) >= width
        name[1:] = np.cumsum(~alike)
    names = np.empty(len(order), np.int64)
    names[of] = name
    order, shared = _ranked(seeds, names, width)
    seeds_sorted = seeds[order]
    lcp = np.zeros(len(seeds), np.uint8)
    lcp[1:] = common(word, seeds_sorted[1:], seeds_sorted[:-1], width, shared[1:])
    for at, c, _ in _induce(text, word, sigma, seeds_sorted, lcp, width, True, held):
        yield at, c
