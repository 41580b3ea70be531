import re

from loomvault.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def dup_chars(text, n):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - n + 1):
        at.setdefault(tuple(w[i : i + n]), []).append(i)
    return sum(len(w[j]) for j in {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + n)})


def test_measures_match_brute_force(docs, rows):
    got = [r.asDict() for r in quality.measure(docs).collect()]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"dup_{n}gram_chars" for n in quality.NGRAM_LIMITS)]
    want = [(x["doc_id"], *brute(x["text"]), *(dup_chars(x["text"], n) for n in quality.NGRAM_LIMITS)) for x in rows]
    assert sorted((tuple(r[k] for k in names) for r in got), key=str) == sorted(want, key=str)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_keep_returns_whole_rows(docs, empty):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.measure(docs).filter("kept").count() > 0
    assert quality.keep(empty).count() == quality.measure(empty).count() == 0


def test_repetition_is_rejected():
    import pyarrow as pa

    text = " ".join(["buy this now and save big money today friends"] * 9)
    m = quality._measures(pa.array([text, " ".join(f"w{i}" for i in range(60))]))
    assert m["kept"].tolist() == [False, True]
