"""Hits as Markdown, and the fixed prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def block(path: Column, heading_path: Column, content: Column, tokens: Column, score: Column) -> Column:
    """One hit: a comment with its figures, its last heading (or the note's name), and its text."""
    name = F.when(F.size(heading_path) > 0, F.element_at(heading_path, -1)).otherwise(F.regexp_replace(paths.last_segment(path), r"\.md$", ""))
    figures = F.when(score.isNull(), F.lit("")).otherwise(F.concat(F.lit(" | score: "), F.format_string("%.2f", score)))
    text = F.regexp_replace(content, r"(?U)\A\s+|\s+\z", "")
    return F.concat(F.lit("<!-- "), path, figures, F.lit(" | tokens: "), tokens.cast("string"), F.lit(" -->\n\n## "), name, F.lit("\n\n"), text, F.lit("\n"))


def render(hits: DataFrame) -> DataFrame:
    """One row: the hits (as few as a search's limit) in the order of their notes' best scores, then of rank."""
    best = hits.groupBy("note_path").agg(F.max("score").alias("best"))
    rows = hits.join(best, "note_path").select(F.struct((-F.coalesce("best", F.lit(0.0))).alias("o"), "note_path", "rank", block(F.col("note_path"), F.col("heading_path"), F.col("content"), F.col("token_count"), F.col("score")).alias("b")).alias("x"))
    return rows.agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n---\n\n")).alias("markdown"))


def explore_topic(topic: str, folder: str | None = None) -> str:
    where = f" in the folder {folder!r}" if folder else ""
    return f"Find everything that the vault says about {topic!r}{where}: search, read the best notes, follow their links, and sum up what is known and what is missing."


def summarise_project(folder: str) -> str:
    return f"Report on the project in {folder!r}: find its notes with folder:{folder}, read each, and describe key documents, open points, tags and structure."
