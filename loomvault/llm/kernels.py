"""Vectorised word kernels shared by the text operators.

All of them work on UTF-8 bytes. A word is a maximal run of bytes other than the six ASCII white-space bytes
(9 to 13 and 32), which is the same as a run of `[^\\x20\\x09-\\x0D]+` in code points, since bytes of a multi-byte
code point are never below 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once: bounds a worker's memory whatever the size of the Arrow batch.
CHUNK_BYTES = 1 << 20
#: Longer words are hashed by BLAKE2, as the polynomial below is weak on very long structured strings.
LONG_WORD = 512

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Random values by byte.
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(n + 1, np.uint64)
        filled, step = 1, b % (1 << 64)
        while filled <= n:
            k = min(filled, n + 1 - filled)
            p[filled : filled + k] = p[:k] * _U(step)
            filled, step = filled + k, step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


_POW: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW
    if _POW is None or len(_POW[0]) <= n:
        _POW = _powers(int(_BASE), max(n, CHUNK_BYTES + 65536))
    return _POW


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of up to `limit` bytes; a longer row comes alone. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words of a run of rows: byte starts and ends, the row of each, and the index of each row's first word."""

    __slots__ = ("buf", "start", "end", "row", "first", "n_rows")

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.n_rows = buf, len(offs) - 1
        gap = SPACE[buf]
        edge = np.empty(len(buf) + 1, bool)
        if len(buf):
            edge[0], edge[-1] = not gap[0], not gap[-1]
            np.not_equal(gap[1:], gap[:-1], out=edge[1:-1])
        else:
            edge[0] = False
        cut = np.flatnonzero(edge)
        start, end = cut[0::2], cut[1::2]
        inner = offs[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(buf))])
        if len(inner):  # rows whose border lies inside a run
            inner = inner[~gap[inner] & ~gap[inner - 1]]
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offs).astype(np.int64)
        self.row = np.repeat(np.arange(self.n_rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, lower)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the bytes in [start, end), alike for equal bytes wherever they stand. lower: A-Z count as a-z."""
    out = np.empty(len(start), np.uint64)
    table = _BYTE[_LOWER] if lower else _BYTE
    i = 0
    while i < len(start):
        at = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, at + CHUNK_BYTES, "right")))
        piece = buf[at : int(end[j - 1])]
        if len(piece) > 2 * CHUNK_BYTES:  # one huge span
            out[i] = 0
        else:
            pw, inv = powers(len(piece))
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(table[piece] * pw[: len(piece)], out=total[1:])
            s, e = start[i:j] - at, end[i:j] - at
            out[i:j] = (total[e] - total[s]) * inv[s]
        i = j
    out = mix(out ^ mix((end - start).astype(np.uint64)))
    for k in np.flatnonzero(end - start > LONG_WORD):
        raw = buf[start[k] : end[k]]
        out[k] = int.from_bytes(hashlib.blake2b((_LOWER[raw] if lower else raw).tobytes(), digest_size=8).digest(), "little")
    return out


def windows(words: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every window of k words that stays within its row; first: index of each row's first word, and the end."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = (int(_BASE) * (2 * seed + 3)) % (1 << 64) | 1
    h = np.zeros(n - k + 1, np.uint64)
    if k <= 8:
        for i in range(k):
            h = h * _U(base) + words[i : n - k + 1 + i]
    else:
        pw, inv = _powers(base, n) if seed else powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * pw[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * inv[: n - k + 1]
    inside = np.ones(n - k + 1, bool)
    for j in range(1, k):  # windows that would cross into the next row
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(inside))]
        inside[at] = False
    start = np.flatnonzero(inside)
    return start, mix(h[start] ^ _U(seed))


def code_points(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points in each [start, end)."""
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return lead[end] - lead[start]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it stand anywhere else; has it stood before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def covered(start: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + k) for some s."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, np.minimum(start + k, n), -1)
    return np.cumsum(d[:-1]) > 0
