"""What each pattern of the note format repeats, at a length at which recursion by repeats would end the JVM."""

import pytest
from pyspark.sql import functions as F

from loomvault.functions import markdown as md
from loomvault.functions import text
from loomvault.operators import edits, sections

N = 50_000
LONG = {
    "tags of frontmatter": "---\ntitle: t\ntags:\n" + "  - tag\n" * N + "---\nbody",
    "lines of frontmatter": "---\n" + "key: value\n" * N + "---\nbody",
    "no end of frontmatter": "---\n" + "key: value\n" * N,
    "marks of a heading": "#" * N + "\n# " + "# " * N + "\n## a " + "#" * N,
    "headings": "# h\n" * 2_000,
    "wikilink": "[[" + "a" * N + "#" + "b" * N + "^" + "c" * N + "|" + "d" * N + "]]",
    "wikilinks": "[[a]] " * N,
    "markdown link": "[" + "a" * N + "](" + "b" * N + ' "' + "c" * N + '")',
    "markdown links": "[a](b) " * N,
    "addresses": "<https://" + "a" * N + "> <" + "b" * N + "@" + "c" * N + "> " + "<u@m> " * N,
    "code": "```" + "\n#no" * N + "\n```" + "``" + "b" * N + "`` `" + "c" * N + "`",
    "tag": "#" + "a/" * N + " " + "#t " * N,
    "task": "- [x] " + "a " * N + "\n" + "\t" * N + "- [ ] b\n",
    "tasks": "- [ ] a\n" * 5_000,
    "white space": " \t\n" * N,
    "words": "word " * N,
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(LONG.values())], "path string, content string")


def test_notes_and_sections_of_long_texts(files):
    n = {r["path"]: r for r in sections.notes(files).collect()}
    assert n["0.md"]["title"] == "t" and n["0.md"]["tags"] == ["tag"]
    assert n["6.md"]["word_count"] == N
    s = sections.sections(files).groupBy("note_path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("links")).alias("links"), F.sum(F.size("tasks")).alias("tasks")).collect()
    s = {list(LONG)[int(r["note_path"][:-3])]: r for r in s}
    assert s["wikilink"]["links"] == 1 and s["markdown link"]["links"] == 1 and s["addresses"]["links"] == 3
    assert s["task"]["tasks"] == 2 and s["tasks"]["tasks"] == 5_000
    assert "white space" not in s


def test_edits_and_links_of_long_texts(files):
    out = edits.rename_links(files, "a", "b").select("changed", F.length("rewritten").alias("n"), md.parse_link(F.col("content")).alias("p"), F.size(text.ngrams(F.substring("content", 1, 2_000))).alias("g"))
    assert sum(r["changed"] for r in out.collect()) >= 1
