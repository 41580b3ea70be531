import math

import pytest
from pyspark.sql import functions as F

from loomvault.operators import catalog, graph, index, render, search, sections
from loomvault.operators.query import QueryError, parse

NOTES = [
    ("wiki/Rust.md", "---\ntags:\n  - programming/rust\n---\n# Rust\nRust is a programming language. [[Home]]\n## Async\nasync rust programming rust #async"),
    ("Home.md", "# Home\nSee [[Rust]] and [[wiki/Rust|r]] [x](./other.md) #home"),
    ("wiki/Python.md", "# Python\nPython programming language #programming #project"),
    ("projects/App.md", "# App\nAn app #projects"),
]


@pytest.fixture(scope="module")
def s(spark):
    return sections.sections(spark.createDataFrame(NOTES, "path string, content string")).cache()


def test_query_language():
    q = parse('async tag:rust tag:"a b" folder:wiki "two words" tag: x tag:""')
    assert (q.text, q.tags, q.folders) == ("async two words tag: x", ["rust", "a b"], ["wiki/"])
    assert parse('"open').text == "open" and parse("").empty and parse('folder:"x/').folders == ["x/"]
    with pytest.raises(QueryError):
        parse("folder:../escape")


def test_bm25(s):
    docs = [r.asDict() for r in s.select("section_path", "tokens").collect()]
    n, mean = len(docs), sum(len(d["tokens"]) for d in docs) / len(docs)

    def score(d):
        total = 0.0
        for t in ("rust", "programming", "rust"):
            df, tf = sum(t in x["tokens"] for x in docs), d["tokens"].count(t)
            total += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d["tokens"]) / mean))
        return total

    want = {d["section_path"]: score(d) for d in docs if score(d) > 0}
    got = {r["section_path"]: r["score"] for r in search.bm25(s, s, "rust programming rust").collect()}
    assert got == pytest.approx(want)
    stored = {r["section_path"]: r["score"] for r in search.bm25_postings(index.postings(s), index.corpus(s), "rust programming rust").collect()}
    assert stored == pytest.approx(want)


def test_filters(s):
    names = lambda df: sorted({r["note_path"] for r in df.collect()})
    assert names(search.candidates(s, tags=["programming"])) == ["wiki/Python.md", "wiki/Rust.md"]
    assert names(search.candidates(s, tags=["project"])) == ["wiki/Python.md"]
    assert names(search.candidates(s, folders=["wiki/"], exclude=["project"])) == ["wiki/Rust.md"]


def test_fusion_is_exact_with_deep_ranks(spark):
    a = spark.range(3000).select(F.format_string("k%05d", "id").alias("section_path"), (3000 - F.col("id")).cast("double").alias("score"))
    b = spark.range(3000).select(F.format_string("k%05d", "id").alias("section_path"), F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double").alias("score"))
    ranks = []
    for x in (a, b):
        rows = sorted(((r["section_path"], r["score"]) for r in x.collect()), key=lambda r: (-r[1], r[0]))
        ranks.append({k: i + 1 for i, (k, _) in enumerate(rows)})
    want = sorted(((k, 1 / (60 + ranks[0][k]) + 1 / (60 + ranks[1][k])) for k in ranks[0]), key=lambda r: (-r[1], r[0]))[:7]
    got = search.rrf([a, b], limit=7)
    assert [k for k, _ in got] == [k for k, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want])


def test_search(s):
    assert [r["note_path"] for r in search.search(s, "rust").collect()][0] == "wiki/Rust.md"
    assert search.search(s, "  ").count() == 0
    only = search.search(s, "folder:wiki").collect()
    assert {r["note_path"] for r in only} == {"wiki/Python.md", "wiki/Rust.md"} and all(r["max_score"] is None for r in only)
    total = search.hits(s, "programming", limit=2)
    assert total.count() == 2 and search.hits(s, "programming", limit=2, threshold=1.0).count() == 0
    assert search.hits(s, "programming", token_limit=1).count() == 0


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, 10)], "rank int, token_count int")
    assert [r["rank"] for r in search.within_budget(df, 150).collect()] == [1]


def test_render(s):
    out = render.render(search.hits(s, "async", limit=1)).first()["markdown"]
    assert out.startswith("<!-- wiki/Rust.md | score: 0.0") and "## Async" in out


def test_catalogue_and_graph(spark, s):
    counts = {r["tag"]: r["notes"] for r in catalog.tag_counts(s).collect()}
    assert counts["programming/rust"] == 1 and counts["programming"] == 1
    children = {r["tag"]: r["children"] for r in catalog.tag_children(catalog.tag_counts(s)).collect()}
    assert children["programming"] == ["programming/rust"] and children["project"] == []
    notes = sections.notes(spark.createDataFrame(NOTES, "path string, content string"))
    assert {r["folder"]: r["notes"] for r in catalog.folder_counts(notes).collect()} == {"wiki/": 2, "projects/": 1}
    e = graph.edges(s)
    assert {(r["path"], r["source"]) for r in graph.backlinks(e, notes).collect()} == {("wiki/Rust.md", "Home.md"), ("Home.md", "wiki/Rust.md")}
    assert {(r["path"], r["source"]) for r in graph.path_backlinks(e, notes).collect()} == {("wiki/Rust.md", "Home.md")}
    assert {r["target"] for r in graph.forward_links(e).filter("note_path = 'Home.md'").collect()} == {"Rust.md", "wiki/Rust.md", "./other.md"}
    assert {r["target"] for r in graph.dangling(graph.forward_links(e), notes).collect()} == {"./other.md"}


def test_store(spark, s, tmp_path):
    store = index.Store(spark, f"file://{tmp_path}/index")
    assert store.load("postings") is None
    store.build(s)
    assert store.load("corpus").first()["n"] == s.count() and store.load("postings").count() == index.postings(s).count()
    found = search.hits(store.load("sections"), "rust language", postings=store.load("postings"), corpus=store.load("corpus"))
    assert [tuple(r) for r in found.select("section_path", "rank", F.round("score", 9)).collect()] == [tuple(r) for r in search.hits(s, "rust language").select("section_path", "rank", F.round("score", 9)).collect()]
    # a note goes, another one changes, a third one was never there; twice, as a replay would
    new = sections.sections(spark.createDataFrame([("wiki/Rust.md", "# Rust\nrust rust oxide")], "path string, content string"))
    for _ in range(2):
        store.change(new, spark.createDataFrame([("Home.md",), ("none.md",)], "note_path string"))
        want = index.upsert(s, new, s.filter("note_path = 'Home.md'").select("note_path"))
        again = index.Store(spark, f"file://{tmp_path}/index")
        rows = lambda df: sorted(map(str, df.drop("last_indexed").collect()))
        assert rows(again.load("sections").select("section_path", "tokens")) == rows(want.select("section_path", "tokens"))
        assert rows(again.load("postings").select(*index.postings(want).columns)) == rows(index.postings(want))
        assert rows(again.load("corpus")) == rows(index.corpus(want))
    store.compact()
    assert rows(store.load("postings").select(*index.postings(want).columns)) == rows(index.postings(want))
    (tmp_path / "index" / "state-99.json").write_text('{"sections": ')  # a state file that was broken off
    assert rows(store.load("corpus")) == rows(index.corpus(want))


def test_resources(s, spark):
    r = sections.section_resource(s, "wiki/Rust.md", ["Rust", "Async"])
    assert (r["section_path"], r["tags"], r["word_count"]) == ("wiki/Rust.md#Rust/Async", ["async", "programming/rust"], 7)
    with pytest.raises(sections.SectionError, match="wiki/Rust.md#Rust, wiki/Rust.md#Rust/Async"):
        sections.section_resource(s, "wiki/Rust.md", ["None"])
    assert sections.note_resource(spark.createDataFrame(NOTES, "path string, content string"), "Home.md")["title"] == "Home"
    (n,) = catalog.notes_indexed(s, "wiki/Rust.md").collect()
    assert n["sections"] == ["wiki/Rust.md#Rust", "wiki/Rust.md#Rust/Async"] and n["links"][0]["target"] == "Home"
    assert catalog.notes_indexed(s, "none.md").count() == 0
    assert {x["note_path"] for x in catalog.notes_indexed(s, folder="wiki/").collect()} == {"wiki/Rust.md", "wiki/Python.md"}
    assert {x["note_path"] for x in catalog.notes_indexed(s, folder="projects/", recursive=False).collect()} == {"projects/App.md"}
    p = sections.parsed(spark.createDataFrame(NOTES, "path string, content string")).filter("path = 'wiki/Rust.md'").first()
    assert sections.serialise("tags:\n  - programming/rust", p["chunks"]) == NOTES[0][1]
