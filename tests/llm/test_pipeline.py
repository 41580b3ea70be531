import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomvault.llm import quality
from loomvault.llm.encode import tokenizer_path

from .test_jaccard import brute as brute_groups


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    from .conftest import SCHEMA

    root = tmp_path_factory.mktemp("sf")
    leak = " ".join(rows[2]["text"].split()) if len(rows[2]["text"].split()) > 20 else rows[0]["text"]
    spark.createDataFrame([tuple(x[k.split()[0]] for k in SCHEMA.split(", ")) for x in rows], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_run_matches_brute_force(spark, folder, rows):
    """Stage by stage, row by row: what each keeps of what came in, by plain Python over all rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    state = [dict(zip(columns, r, strict=True)) for r in docs.collect()]
    plain = lambda t: " ".join((t or "").lower().split())

    kept = {(r["doc_id"], r["n_words"], r["n_repeat_words"]): r["kept"] for r in quality.measure(docs).collect()}

    def quality_rules(rows):
        out = []
        for x in rows:
            w = (x["text"] or "").encode().split()
            windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
            failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
            verdict = kept[x["doc_id"], len(w), len(repeated)]  # the method's own limits have a brute force of their own
            assert not (failed and verdict)
            out += [x] if verdict else []
        return out

    def near_duplicates(rows):
        _, group = brute_groups(rows, 5, 80)
        best = {}
        for x, g in zip(rows, group, strict=True):
            order = (x["doc_id"] is None, x["doc_id"] or 0)
            if g not in best or order < best[g][0]:
                best[g] = (order, x)
        return [x for _, x in best.values()]

    def decontamination(rows):
        return [x for x in rows if plain(item) not in plain(x["text"])]

    def secret_scan(rows):
        assert not any(re.search("secret|token|password|AKIA|[0-9a-f]{32}", x["text"]) for x in rows)  # masks have tests of their own
        return rows

    steps = [quality_rules, near_duplicates, decontamination, secret_scan]
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs = corpus_pipeline.stash(stage(spark, docs, folder), name)
        state = by_hand(state)
        assert docs.columns == columns
        facts = lambda x: tuple(str(x[c]) for c in columns)
        assert sorted(facts(r) for r in docs.collect()) == sorted(map(facts, state)), name
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {}
    for x in state:
        ids.setdefault(x["doc_id"], []).append(tokenizer.encode(x["text"], add_special_tokens=False).ids + [1])
    pieces = corpus_pipeline.run(spark, folder).collect()
    end = 0
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert 2048 * r["sequence_id"] + r["offset"] == end
        end += r["length"]
    assert end == sum(len(x) for v in ids.values() for x in v)
    for doc_id, lists in ids.items():
        mine = sorted((r for r in pieces if r["doc_id"] == doc_id), key=lambda r: r["start"])
        if len(lists) == 1:
            assert [i for r in mine for i in np.frombuffer(r["ids"], "<u2").tolist()] == lists[0]


def test_decontamination_drops_leaking_rows_only(spark, tmp_path):
    leak, clean = "the quick brown fox jumps over the lazy dog near the old river bank today", "some clean text about the weather"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, text) for i in (None, 7) for text in (leak, clean, None)] + [(8, leak), (9, clean)]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert left.columns == ["doc_id", "text"]
    assert sorted(map(str, left.collect())) == sorted(map(str, spark.createDataFrame([x for x in rows if x[1] != leak], left.schema).collect()))
