"""The index without texts: what it writes, and that its tables are those of the whole index."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomvault.functions import markdown as md
from loomvault.operators import index, sections
from loomvault.plans import queries
from loomvault.sources.projection import vault

SF = "/root/testdata/sf0.001"
#: Each with the number of its finding; they need no texts of all sections.
LIGHT = [
    "dangling_links", "folder_counts_below", "folder_direct", "folder_info", "link_infos", "tag_exclude", "tag_expand", "tag_expand_range", "tag_jaccard",
    "tag_jaccard_postings", "tag_prefix", "tag_tree", "vault_info", "view_tags", "notes_grouped", "render_hits", "section_resources",
]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", LIGHT)
def test_no_texts_are_stored(spark, name, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "_STORES", {})
    monkeypatch.setattr(index.Store, "_write", lambda self, df, table, meta, write=index.Store._write: made.append((table, set(df.columns))) or write(self, df, table, meta))
    queries.QUERIES[name](spark, SF).collect()
    assert not [table for table, columns in made if columns & {"content", "tokens"}]
    assert ("blocks" in dict(made)) == (name in ("notes_grouped", "render_hits"))


def test_tables_of_an_outline_are_those_of_the_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "OUTLINE_ROWS", 100)
    all_ = index.indexed(sections.sections(vault(spark, SF)))
    one, other = index.Store(spark, f"file://{tmp_path}/whole"), index.Store(spark, f"file://{tmp_path}/outline", texts=lambda: all_)
    one.build(all_)
    other.build(all_.drop(*index.TEXTS))
    kept = other.load("sections")
    assert rows(kept) == rows(one.load("sections").select(*kept.columns))
    for table in ("postings", "grams", "tagged", *index.VIEWS):
        assert rows(other.load(table)) == rows(one.load(table)), table
    assert rows(other.load("corpus").drop("last_indexed")) == rows(one.load("corpus").drop("last_indexed"))
    assert len(list(Path(tmp_path, "outline").glob("sections-*/part-*"))) > 3  # lists are made by many tasks
    with pytest.raises(ValueError, match="without texts"):  # words of changed notes are not known
        other.change(all_.drop(*index.TEXTS).limit(1), spark.createDataFrame([], "note_path string"))
    assert rows(other.load("postings")) == rows(one.load("postings"))
    fork = other.fork(f"file://{tmp_path}/fork")
    with pytest.raises(ValueError, match="without texts"):
        fork.load("postings")


def test_texts_are_searched_only_where_a_match_can_be(spark):
    text = "[`x`[ab]]#`y`t `z` #u [[p|q]] [r](s.md) <http://a.b> <c@d> "
    one = spark.createDataFrame([(text,), ("#`",), ("plain",), (None,)], "t string").select(md.links(F.col("t")).alias("l"), md.tags(F.col("t")).alias("g")).collect()
    assert [x["kind"] for x in one[0]["l"]] == ["wiki", "markdown", "url", "email"] and one[0]["g"] == ["t", "u"]
    assert [(x["l"], x["g"]) for x in one[1:]] == [([], []), ([], []), (None, None)]
