import random
import time

import numpy as np
import pytest

from loomvault.llm import induction


def shard(pieces):
    """Symbols of pieces with 0 after each, and room behind."""
    out = []
    for p in pieces:
        out += [b + 1 for b in p] + [0]
    return np.array(out, np.uint16), len(out)


def texts(r):
    yield [bytes(r.choice(b"ab") for _ in range(r.randint(1, 80))) for _ in range(6)]
    yield [b"a" * 90, b"a" * 50 + b"b", b"ba" * 40, b"", b"a"]
    yield [bytes(r.randrange(256) for _ in range(300))]
    base = bytes(r.choice(b"the cat sat") for _ in range(200))
    yield [base[r.randrange(100) :] + bytes([r.randrange(256)]) for _ in range(9)]
    yield [b"abcabcabc" * 20, b"zyxzyx" * 20, b"\x00\x01\x00\x00" * 12, b"\xff" * 70]
    yield [b"x"]


@pytest.mark.parametrize(("width", "block", "held"), [(5, 1 << 16, 1 << 26), (20, 7, 1 << 26), (100, 64, 0)])
def test_order_and_common_prefixes(width, block, held, monkeypatch):
    monkeypatch.setattr(induction, "BLOCK", block)
    monkeypatch.setattr(induction, "ARRAY", 64 if not held else 1 << 26)
    r = random.Random(width)
    for _ in range(6):
        for pieces in texts(r):
            symbols, n = shard(pieces)
            text = induction.room(n + width + induction.WORD, np.uint16)
            text[:n] = symbols
            at, lcp = (np.concatenate(x) for x in zip(*induction.suffixes(text, n, 257, width, held), strict=True))
            assert sorted(at.tolist()) == list(range(n - 1))
            keys = [symbols[p : p + width].tolist() for p in at.tolist()]
            ends = [k.index(0) if 0 in k else width for k in keys]
            for j in range(1, len(keys)):
                a, b = keys[j - 1], keys[j]
                assert a[: ends[j - 1] + 1] >= b[: ends[j] + 1] or a > b
                same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                if same <= min(ends[j - 1], ends[j]):  # before a piece ends
                    assert lcp[j] == same


def test_time_follows_the_input():
    r = np.random.default_rng(1)
    words = [bytes(r.integers(97, 123, r.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    took = []
    for n in (60_000, 240_000):
        raw = b" ".join(words[i] for i in r.integers(0, 3000, n))
        symbols, size = shard([raw[i : i + 140] for i in range(0, len(raw), 140)])
        text = np.append(symbols, np.zeros(100 + induction.WORD, np.uint16))
        began = time.perf_counter()
        assert sum(len(a) for a, _ in induction.suffixes(text, size, 257, 100)) == size - 1
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1
