"""Tags, folders and figures of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def tag_counts(sections: DataFrame, prefix: str | None = None) -> DataFrame:
    """tag and the number of notes that have it. prefix: tags that start with it, whatever follows."""
    tags = sections.select("note_path", F.explode("tags").alias("tag"))
    if prefix:
        tags = tags.filter(F.col("tag").startswith(prefix))
    return tags.groupBy("tag").agg(F.count_distinct("note_path").alias("notes")).orderBy("tag")


def tag_tree(tagged: DataFrame) -> DataFrame:
    """Each tag, or folder of tags, with its depth and the number of notes that have it or one below it; from the postings of tags (operators.index)."""
    parts = F.split("tag", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    notes = tagged.select("note_path", F.explode(above).alias("tag")).distinct()
    return notes.groupBy("tag").agg(F.count(F.lit(1)).alias("notes")).select("tag", F.size(F.split("tag", "/")).alias("depth"), "notes")


def tag_children(counts: DataFrame) -> DataFrame:
    """Each tag with its direct children among the tags: names joined in order."""
    child = counts.select(F.regexp_extract("tag", "^(.*)/[^/]*$", 1).alias("above"), F.col("tag").alias("child"))
    lists = child.filter("above <> ''").groupBy("above").agg(F.array_sort(F.collect_list("child")).alias("children"))
    return counts.join(lists, counts["tag"] == lists["above"], "left").select("tag", "notes", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def folder_counts(notes: DataFrame, folder: str = "") -> DataFrame:
    """folder and the number of notes directly in it, for the folder given and all below it; notes at the root are in none."""
    return notes.filter(F.col("folder").isNotNull() & paths.is_under_folder(F.col("folder"), folder)).groupBy("folder").agg(F.count(F.lit(1)).alias("notes")).orderBy("folder")


def info(sections: DataFrame, folder: str = "") -> DataFrame:
    """One row: notes and distinct tags below a folder."""
    below = sections.filter(paths.is_under_folder(F.col("note_path"), folder)).select("note_path", F.explode_outer("tags").alias("tag"))
    return below.agg(F.count_distinct("note_path").alias("note_count"), F.count_distinct("tag").alias("tag_count"))


def notes_indexed(sections: DataFrame, path: str | None = None, folder: str = "", recursive: bool = True) -> DataFrame:
    """The indexed notes of a folder, or the one at path (no row if it is not indexed): sections, tags, links and tokens of each."""
    test = paths.is_under_folder if recursive else paths.is_in_folder
    some = sections.filter(F.col("note_path") == path) if path is not None else sections.filter(test(F.col("note_path"), folder)) if folder or not recursive else sections
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "section_path", "links"))).alias("parts")
    out = some.groupBy("note_path").agg(parts, F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.sum("token_count").alias("token_count"))
    return out.select("note_path", F.col("parts.section_path").alias("sections"), "tags", F.flatten("parts.links").alias("links"), "token_count")


def note_list(sections: DataFrame, folder: str = "", recursive: bool = True) -> DataFrame:
    """Paths of the indexed notes of a folder."""
    test = paths.is_under_folder if recursive else paths.is_in_folder
    return sections.filter(test(F.col("note_path"), folder)).select("note_path").distinct()
