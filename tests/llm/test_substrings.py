import hashlib
import random
from collections import Counter

import numpy as np

from loomvault.llm import substrings
from loomvault.llm.recompress import anchors, levels


def brute(rows, width):
    words = [(x["text"] or "").encode().split() for x in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for x, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = b" ".join(a for j, a in enumerate(w) if j not in gone)
        out.append((str(x["doc_id"]), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_matches_brute_force(docs, rows, empty, monkeypatch):
    want = brute(rows, 35)
    for hot in (20000, 1):  # the second compares all symbols by aggregation
        monkeypatch.setattr(substrings, "HOT", hot)
        for digest in (False, True):
            kept = lambda r: r["kept"] if digest else hashlib.sha256(r["kept"].encode()).hexdigest()  # noqa: B023, E731
            got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], kept(r)) for r in substrings.dedup(docs, digest=digest).collect())
            assert got == want
            if hot == 1:
                break
    assert substrings.dedup(empty).count() == 0


def test_equal_windows_choose_equal_symbols():
    r = random.Random(3)
    for rounds in (1, 2, 3, 4):
        shared = [r.randrange(1, 40) for _ in range(60)]
        a = [r.randrange(1, 40) for _ in range(50)] + shared + [r.randrange(1, 40) for _ in range(50)]
        b = shared + [7] * 50
        words = np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in a + b], np.uint64)
        row = np.array([0] * len(a) + [1] * len(b))
        *_, s = levels(words, row, rounds)
        best = anchors(s, np.array([0, len(a), len(a) + len(b)]), 35)
        for i in range(60 - 34):
            p, q = best[50 + i], best[len(a) + i]
            assert (p < 0) == (q < 0)
            if p >= 0:
                assert s.name[p] == s.name[q] and s.start[p] - 50 - i == s.start[q] - len(a) - i
