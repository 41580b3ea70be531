"""The link graph of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def edges(sections: DataFrame) -> DataFrame:
    """note_path and one link of it in each row."""
    return sections.select("note_path", F.explode("links").alias("link")).select("note_path", "link.*")


def backlinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """path, source: notes with a wikilink whose target is exactly the stem of path."""
    wiki = links.filter("kind = 'wiki'").select(F.col("note_path").alias("source"), "target").distinct()
    ends = notes.select("path", paths.stem(F.col("path")).alias("target"))
    return wiki.join(ends, "target").select("path", "source")


def path_backlinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """As backlinks, for targets written with their folders."""
    wiki = links.filter("kind = 'wiki' and target like '%/%'").select(F.col("note_path").alias("source"), F.regexp_replace("target", r"\.md$", "").alias("target")).distinct()
    ends = notes.select("path", F.regexp_replace("path", r"\.md$", "").alias("target"))
    return wiki.join(ends, "target").select("path", "source")


def forward_links(links: DataFrame) -> DataFrame:
    """note_path, target: where links lead. Wikilinks get the note extension, web addresses and e-mail have no target here."""
    target = F.when(F.col("kind") == "wiki", F.when(F.col("target").endswith(".md"), F.col("target")).otherwise(F.concat("target", F.lit(".md"))))
    target = target.when((F.col("kind") == "markdown") & ~F.col("target").startswith("http"), F.col("target"))
    out = links.select("note_path", paths.normalise(target).alias("target")).filter(F.col("target").isNotNull() & (F.col("target") != ""))
    return out.filter(paths.kind(F.col("target")).isNotNull()).distinct()


def dangling(forward: DataFrame, notes: DataFrame) -> DataFrame:
    """Forward links to notes that do not exist, by path or by stem."""
    known = notes.select(F.col("path").alias("target")).union(notes.select(F.concat(paths.stem(F.col("path")), F.lit(".md")))).distinct()
    return forward.join(known, "target", "left_anti").select("note_path", "target")
