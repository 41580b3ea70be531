import pytest
from pyspark.sql import functions as F

from loomvault.functions import frontmatter as fm
from loomvault.functions import markdown as md
from loomvault.functions import text
from loomvault.functions.stemming import detect, english, german
from loomvault.operators import sections


@pytest.fixture(scope="module")
def one(spark):
    def run(expr, value):
        return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("x")).first()["x"]

    return run


def test_tags(one):
    assert one(md.tags, "Version #v2 and #release-3 but not #123.") == ["release-3", "v2"]
    assert one(md.tags, "A #café tag and #naïve too.") == ["café", "naïve"]
    assert one(md.tags, "[[#heading]] and [[note#section]]") == []
    assert one(md.tags, "```\n#no\n``` `#no` ``#no`` #tag a#b") == ["b", "tag"]
    assert one(md.is_tag, "#a/b") and not one(md.is_tag, "#12")


def test_wikilinks(one):
    got = one(md.wikilinks, "[[a]] ![[b|c]] [[d#e]] [[f#^g]] [[h#i#^j|k]]")
    assert [(x["target"], x["alias"], x["heading"], x["block_ref"], x["is_embed"]) for x in got] == [("a", None, None, None, False), ("b", "c", None, None, True), ("d", None, "e", None, False), ("f", None, None, "g", False), ("h", "k", "i", "j", False)]
    assert one(lambda c: F.transform(md.wikilinks(c), md.link_text), "![[h#i#^j|k]]") == ["![[h#i#^j|k]]"]


def test_other_links(one):
    got = one(md.links, '[text](./path.md "a title") <https://example.com> <user@example.com> [text](./path.md "a title")')
    assert [(x["kind"], x["target"], x["title"]) for x in got] == [("markdown", "./path.md", "a title"), ("url", "https://example.com", None), ("email", "user@example.com", None)]


def test_tasks(one):
    got = one(md.tasks, "- [ ] a\n  - [x] b\r\n- [X] c\n- [-] d\n- [>] e\n-[ ] no\n- [ ]\nx")
    assert [(t["line"], t["status"], t["text"]) for t in got] == [(0, "open", "a"), (1, "done", "b"), (2, "done", "c"), (3, "canceled", "d"), (4, "custom", "e"), (6, "open", "")]


def test_sections(spark):
    files = [("n.md", "---\ntitle: T\ntags:\n  - x/y\n---\nintro\n# A\na\n## B ##\n#tag\n### C\nc\n## D\nd\n# E"), ("q.md", "intro\n#\n## Real\ntext\n## Next\nx"), ("e.md", " \n "), ("d.md", "# S\none\n# S\ntwo")]
    s = sections.sections(spark.createDataFrame(files, "path string, content string"))
    rows = s.orderBy("note_path", "ordinal").collect()
    assert [r["section_path"] for r in rows if r["note_path"] == "n.md"] == ["n.md", "n.md#A", "n.md#A/B", "n.md#A/B/C", "n.md#A/D", "n.md#E"]
    assert [r["content"] for r in rows if r["note_path"] == "d.md"] == ["# S\ntwo"]
    assert next(r for r in rows if r["section_path"] == "n.md#A/B")["tags"] == ["x/y", "tag"]
    n = {r["path"]: r for r in sections.notes(spark.createDataFrame(files, "path string, content string")).collect()}
    assert n["n.md"]["title"] == "T" and n["d.md"]["title"] == "S" and n["q.md"]["title"] is None
    assert n["e.md"]["section_count"] == 0


def test_frontmatter(spark):
    assert fm.parse("")["tags"] == [] and fm.parse("d: 2024-01-15\ny: yes\nb: true")["custom"] == {"d": "2024-01-15", "y": "yes", "b": True}
    for bad in ("tags: x", "a: [", "title: 3", "- x"):
        with pytest.raises(fm.FrontmatterError):
            fm.parse(bad)
        assert fm.parse_lenient(bad)["tags"] == []
    assert fm.split("---\r\na: 1\r\n---\r\nrest") == ("a: 1", "rest")
    patched = fm.patch(fm.parse("title: a\nx: 1\ntags: [t]"), {"x": 2, "z": "q"}, ["title"])
    assert patched["title"] is None and patched["custom"] == {"x": 2, "z": "q"} and fm.parse(fm.dump(patched)[4:-4]) == patched
    rows = spark.createDataFrame([("title: a\ntags: [b]",), ("tags: x",), (None,)], "b string").select(fm.frontmatter("b").alias("f")).collect()
    assert [(r["f"]["title"], r["f"]["tags"], r["f"]["error"] is None) for r in rows] == [("a", ["b"], True), (None, [], False), (None, [], True)]


def test_tokens(one):
    assert one(text.naive_tokens, "Hello, world! How's it going?") == ["hello", "world", "hows", "it", "going"] == text.naive_tokens_of("Hello, world! How's it going?")
    assert one(text.ngrams, "Rust") == ["$$r", "$ru", "rus", "ust", "st$", "t$$"] == text.ngrams_of("Rust")
    assert one(lambda c: text.ngrams(c, 2), "ab") == ["$a", "ab", "b$"] and one(text.ngrams, "") == ["$$$", "$$$"]
    with pytest.raises(ValueError):
        text.ngrams_of("x", 0)
    assert one(text.tokenizer("stemming"), "running quickly") == ["run", "quick"]
    assert one(text.tokenizer("ngram", n=2), "ab") == ["$a", "ab", "b$"]
    with pytest.raises(ValueError):
        text.tokenizer("none")


def test_stemming():
    pairs = {"consistency": "consist", "knightly": "knight", "national": "nation", "hoping": "hope", "cries": "cri", "relational": "relat", "skies": "sky", "generously": "generous"}
    assert {k: english(k) for k in pairs} == pairs
    assert [german(x) for x in ("häuser", "kindern", "schönheit")] == ["haus", "kind", "schonheit"]
    assert detect("the cat of the house".split()) == "en" and detect("der hund und die katze".split()) == "de" and detect([]) == "en"
