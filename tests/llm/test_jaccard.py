import re

import pytest

from loomvault.llm import jaccard


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [shingles(x["text"], k) for x in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, x in enumerate(rows):
        if x["doc_id"] is not None:
            ids[find(i)] = min(ids.get(find(i), x["doc_id"]), x["doc_id"])
    return sorted((str(x["doc_id"]), len(sets[i]), str(ids.get(find(i)) if sets[i] else x["doc_id"])) for i, x in enumerate(rows)), [find(i) if sets[i] else -1 - i for i in range(len(rows))]


@pytest.mark.parametrize(("k", "percent", "block", "blocks", "small"), [(4, 85, 4000, 8, 8), (5, 80, 3, 8, 2), (5, 80, 8, 1, 2)])
def test_components_match_brute_force(docs, rows, k, percent, block, blocks, small, monkeypatch):
    for name, value in (("BLOCK", block), ("BLOCKS", blocks), ("SMALL", small)):
        monkeypatch.setattr(jaccard, name, value)  # regions are cut into blocks, or joined recursively
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.classes(docs, k, percent).collect())
    assert got == brute(rows, k, percent)[0]


def test_one_of_each(docs, rows):
    _, group = brute(rows, 5, 80)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    first = {}  # of each group the least doc_id, nulls last; equal rows are one
    for x, g in zip(rows, group, strict=True):
        if g >= 0 and (g not in first or (x["doc_id"] is None, x["doc_id"] or 0) < (first[g]["doc_id"] is None, first[g]["doc_id"] or 0)):
            first[g] = x
    want = [x for x, g in zip(rows, group, strict=True) if g < 0] + list(first.values())
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(x["doc_id"]) for x in want)


def test_one_of_each_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "p", 1, None), (2, "a b c d e f", "q", 2, "x"), (3, None, None, 3, "y"), (None, "g h", "r", 4, "z")], "doc_id int, text string, h string, K_ID int, th2 string")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(tuple(r)) for r in kept.collect()) == sorted(str(tuple(r)) for r in df.filter("doc_id is null or doc_id <> 2").collect())


def test_empty(empty):
    assert jaccard.classes(empty, 4, 85).count() == 0
    assert jaccard.one_of_each(empty).count() == 0
