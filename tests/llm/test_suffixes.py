import hashlib
import random

import numpy as np
import pytest

from loomvault.llm import bitfilter, suffixes

LAST = (1 << 63) - 1


def brute(rows, width):
    raw = [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, tuple[int, int]] = {}
    for o, _, t in raw:
        for s in range(len(t) - width + 1):
            w = t[s : s + width]
            first[w] = min(first.get(w, (o, s)), (o, s))
    out = []
    for o, i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - width + 1):
            if first[t[s : s + width]] < (o, s):
                gone[s : s + width] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((str(i), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df, digest=True):
    kept = lambda r: bytes(r["kept"]).hex() if digest else hashlib.sha256(r["kept"]).hexdigest()
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], kept(r)) for r in df.collect())


def more(r):
    """Passages inside other texts, edits, runs, periods, NUL and multi-byte characters, parts of long texts."""
    letters = "abcdefghé日 \x00"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [word(n) for n in (99, 100, 101, 140, 400)]
    out = [(1000 + i, word(r.randint(0, 90)) + r.choice(shared) + word(r.randint(0, 60)) + r.choice(shared)) for i in range(60)]
    out += [(2000, "a" * 400), (2001, "b" + "a" * 350), (2002, "ab" * 150), (2003, "xyz" * 200 + "!"), (2004, "q" + "xyz" * 90), (2005, word(5000)), (2006, "é" * 130)]
    out += [(2005, "another " + out[3][1]), (None, out[5][1]), (None, out[5][1]), (None, "prefix" + out[6][1]), (3, out[7][1]), (3, out[7][1])]
    return out


@pytest.mark.parametrize(("hot", "held", "part", "digest", "full"), [(20_000, 64 << 20, 1 << 20, True, False), (1, 64 << 20, 700, True, False), (20_000, 0, 300, False, True)])
def test_matches_brute_force(spark, docs, rows, empty, monkeypatch, hot, held, part, digest, full):
    """hot: anchors with more pieces go another way; held: queues on disk; part: long texts in parts; full: filters that let all through."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    if full:
        monkeypatch.setattr(bitfilter, "build", lambda hashes, bits: b"\xff" * (bits // 8))
    extra = more(random.Random(hot + part))
    table = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(i, t, "k") for i, t in extra], "doc_id long, text string, key string")).repartition(3)
    want = brute([(x["doc_id"], x["text"]) for x in rows] + extra, 100)
    assert result(suffixes.dedup(table, digest=digest, part=part, held=held), digest) == want
    assert suffixes.dedup(empty).count() == 0


def test_other_widths(spark):
    extra = more(random.Random(4))
    table = spark.createDataFrame(extra, "doc_id long, text string")
    for width, gram in ((12, 12), (30, 8), (250, 40)):
        assert result(suffixes.dedup(table, width, gram, digest=True)) == brute(extra, width)


def test_very_long_text(spark):
    r = random.Random(8)
    base = "".join(r.choice("abcdefgh ") for _ in range(40_000))
    table = [(1, base * 60), (2, "x" + base[100:9000])]  # 2.4 MB in several parts
    got = {r["doc_id"]: r for r in suffixes.dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got[1]["kept"] == base.encode() and got[1]["n_spans"] == 1
    assert got[2]["kept"] == b"x"
