import hashlib
import re

import numpy as np
import pytest

from loomvault.llm import infill

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(tokens[:p]), "".join(tokens[p:q]), "".join(tokens[q:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{a}<S>{c}<M>{b}" if form == "psm" else f"<S>{c}<P>{a}<M>{b}"
    return (doc_id, n, form, len(a), len(b), sha(out), sha(text))


@pytest.mark.parametrize(("chunk", "block"), [(1, 3), (7, 20), (64, 64), (1 << 14, 1 << 20)])
def test_places_of_all_ranks_whatever_the_chunks(chunk, block):
    texts = ["", "a", "abc def", "né 12\n\tZz<P", "x" * 100, "日本 abc", "<<SS>>", "A" * 63 + "é" + "b" * 70]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    cut = infill.Cutter(np.frombuffer(b"".join(raw), np.uint8), offs, chunk, block)
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t)
        assert cut.counts()[i] == len(tokens)
        for rank in range(len(tokens) + 1):
            head = "".join(tokens[:rank])
            assert cut.place(i, rank) == (offs[i] + len(head.encode()), len(head))


def test_query_matches_brute_force(spark, docs, rows, empty, tmp_path):
    extra = [(i, t) for i, t in enumerate(["x<P>y", "a <S b> <M", "<P", "<" * 5 + "P>", "word " * 300_000, "é" * 70_000, "\x00a\x00", "ab" * 600_000])]
    spark.createDataFrame(docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).collect(), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in infill.op12_chunked_infill(spark, str(tmp_path)).collect()]
    want = [brute(x["doc_id"], x["text"]) for x in rows] + [brute(i, t) for i, t in extra]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(empty).count() == 0


def test_transform_keeps_columns_and_gives_texts(docs, rows):
    out = infill.transform(docs.withColumnRenamed("th", "fim_text"), seed=7, rate=100, spm=50)
    assert out.columns[-1] == "fim_text_"
    for r in out.collect():
        assert infill.restore(r["fim_text_"].encode(), r["fim_form"]).decode() == (r["text"] or "")
        assert (r["fim_form"] == "plain") == (not r["text"])
