import pytest

from loomvault.config import ConfigError, Settings
from loomvault.functions import markdown as md
from loomvault.operators import resources, search, sections
from loomvault.operators.edits import Vault
from pyspark.sql import functions as F

NOTE = "---\ntitle: T\ntags:\n  - zed\n---\n# One\n\ntext #alpha <a@b.c>\n\n## Two\n\nmore words here\n"


@pytest.fixture(scope="module")
def read(spark):
    files = spark.createDataFrame([("x/n.md", NOTE), ("x/y/m.md", "# M\n\n#alpha/b\n"), ("r.md", "plain\n")], "path string, content string")
    index = sections.sections(files).cache()
    return lambda uri: resources.read(uri, Settings("/some/vault"), index, files)


def test_vault_views(read):
    assert read("v://vault/info") == {"name": "vault", "folder": None, "note_count": 3, "tag_count": 3, "storage_type": "local"}
    assert read("v://vault/info/x/y") == {"name": "vault", "folder": "x/y/", "note_count": 1, "tag_count": 1, "storage_type": "local"}
    assert [tuple(r) for r in read("v://vault/folders").collect()] == [("x/", 1), ("x/y/", 1)]
    assert [tuple(r) for r in read("v://vault/folders/x/y").collect()] == [("x/y/", 1)]
    assert [(r["tag"], r["notes"], r["children"]) for r in read("v://vault/tags").collect()] == [("alpha", 1, ["alpha/b"]), ("alpha/b", 1, []), ("zed", 1, [])]


def test_notes_and_sections(read):
    two = read("v://note/x/n.md#One/Two")
    assert (two["section_path"], two["tags"], two["word_count"]) == ("x/n.md#One/Two", ["zed"], 5)
    assert read("v://note/x/n.md")["title"] == "T"
    with pytest.raises(sections.SectionError, match="x/n.md#One/Two"):
        read("v://note/x/n.md#None")
    for bad in ("nothing", "v://vault/other", "v://note/", "v://else/x"):
        with pytest.raises(resources.ResourceError):
            read(bad)


def test_settings(tmp_path):
    s = Settings.from_env({"STORAGE__PATH": str(tmp_path)})
    assert s.storage == "local" and s.name == tmp_path.name and s.index_path() != Settings("/other").index_path()
    assert Settings("s3a://b/v", "uri", "s3a://b/i").index_path() == "s3a://b/i"
    for bad in (lambda: Settings.from_env({}), lambda: Settings("/v", "tape"), lambda: Settings("s3a://b/v", "uri").index_path()):
        with pytest.raises(ConfigError):
            bad()


def test_parse_link(spark):
    texts = ["![[a/b#H#^x|y]]", '[t](u "v")', "<https://e.org/p>", "<a@b.c>", "no [[link]]", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", md.parse_link(F.col("t")).alias("p")).collect()
    got = {r["t"]: r["p"] and (r["p"]["kind"], r["p"]["target"]) for r in rows}
    assert got == dict(zip(texts, [("wiki", "a/b"), ("markdown", "u"), ("url", "https://e.org/p"), ("email", "a@b.c"), None, None], strict=True))


def test_serialised_note_is_the_note(spark):
    files = spark.createDataFrame([("n.md", NOTE), ("r.md", "plain\n")], "path string, content string")
    assert {r["path"]: r["content"] for r in sections.serialised(files).collect()} == {"n.md": NOTE, "r.md": "plain\n"}


def test_scorers_and_existence(spark):
    index = sections.sections(spark.createDataFrame([("a.md", "# A\n\nx y z\n"), ("b.md", "# B\n\nx\n")], "path string, content string"))
    longest = lambda found, _: found.select("section_path", F.col("token_count").cast("double").alias("score"))
    assert [r["section_path"] for r in search.hits(index, "x", scorers=[longest]).orderBy("rank").collect()] == ["a.md#A", "b.md#B"]
    assert sections.exists(index, "a.md") and sections.exists(index, "a.md", ["A"]) and not sections.exists(index, "a.md", ["B"]) and not sections.exists(index, "c.md")


def test_tracked_revisions(tmp_path):
    v = Vault(str(tmp_path))
    (tmp_path / "u.md").write_text("u")
    with pytest.raises(FileNotFoundError):
        v.delete("u.md")
    v.delete("u.md", v.token("u.md"))
    token = v.save("n.md", "body", {"title": "T"})
    assert v.read_frontmatter("n.md")["title"] == "T" and v.validate("n.md", token) and not v.validate("n.md", "0:0") and v.validate("other.md", "0:0")
    v.delete("n.md")
    assert not v.exists("n.md")
