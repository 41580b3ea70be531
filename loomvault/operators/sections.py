"""Notes and their sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import paths, text


def parsed(files: DataFrame, yaml: bool = False) -> DataFrame:
    """files (path, content) with fm, body, chunks, headings and heading_paths.

    yaml: parse the frontmatter as full YAML by a vectorised UDF; otherwise as plain keys and lists, in the JVM.
    """
    block = md.frontmatter_text(F.col("content"))
    if yaml:
        from ..functions.frontmatter import frontmatter

        fm = frontmatter(block)
    else:
        fm = md.plain_frontmatter(block)
    out = files.withColumn("has_frontmatter", block.isNotNull()).withColumn("fm", fm).withColumn("body", md.body(F.col("content")))
    out = out.withColumn("chunks", md.chunks(F.col("body")))
    out = out.withColumn("headings", F.transform("chunks", md.heading))
    return out.withColumn("heading_paths", md.heading_paths(F.col("headings")))


def title(fm_title: Column, headings: Column) -> Column:
    """The frontmatter's title, else the note's first heading if it is of level 1."""
    first = F.get(F.filter(headings, lambda h: h.isNotNull()), F.lit(0))
    return F.coalesce(F.nullif(fm_title, F.lit("")), F.when(first["level"] == 1, first["text"]))


def notes(files: DataFrame, yaml: bool = False) -> DataFrame:
    """One row for each note: title, tags, headings, links, word count and section count."""
    p = parsed(files, yaml)
    inline = F.array_distinct(F.flatten(F.transform("chunks", md.tags)))
    return p.select(
        "path", paths.parent(F.col("path")).alias("folder"), paths.stem(F.col("path")).alias("stem"), "content", "fm", "has_frontmatter",
        title(F.col("fm.title"), F.col("headings")).alias("title"),
        F.array_sort(F.array_union(F.coalesce("fm.tags", F.array().cast("array<string>")), inline)).alias("tags"),
        F.filter("headings", lambda h: h.isNotNull()).alias("headings"),
        F.flatten(F.transform("chunks", md.links)).alias("links"),
        F.aggregate(F.transform("chunks", md.word_count), F.lit(0), lambda a, x: a + x).alias("word_count"),
        F.size("chunks").alias("section_count"),
    )


def section_path(note: Column, heading_path: Column) -> Column:
    return F.when(F.size(heading_path) == 0, note).otherwise(F.concat(note, F.lit("#"), F.array_join(heading_path, "/")))


def sections(files: DataFrame, yaml: bool = False, tokenizer: Callable[[Column], Column] = text.naive_tokens) -> DataFrame:
    """One row for each section, with tokens, tags, links and tasks. Columns that a query does not use are never computed.

    Of sections with the same path in a note, the last stays. Frontmatter tags belong to every section and come first.
    """
    p = parsed(files, yaml)
    joined = F.transform("heading_paths", lambda h: F.array_join(h, "/"))
    # the first from the end is the last of its path; found in the note's row, so no row carries the whole note
    last = F.get(F.transform(F.array(joined), lambda k: F.get(F.transform(F.array(F.reverse(k)), lambda r: F.transform(k, lambda x, i: F.array_position(r, x) == F.size(k) - i)), F.lit(0))), F.lit(0))
    p = p.select("path", "fm", "chunks", "headings", "heading_paths", last.alias("last"))
    rows = p.select("path", "fm", F.posexplode(F.arrays_zip("chunks", "headings", "heading_paths", "last")).alias("ordinal", "s")).filter("s.last")
    chunk = F.col("s.chunks")
    out = rows.select(
        F.col("path").alias("note_path"), paths.parent(F.col("path")).alias("folder"), "ordinal",
        F.col("s.headings").alias("heading"), F.col("s.heading_paths").alias("heading_path"),
        section_path(F.col("path"), F.col("s.heading_paths")).alias("section_path"), chunk.alias("content"),
        F.array_distinct(F.concat(F.coalesce("fm.tags", F.array().cast("array<string>")), md.tags(chunk))).alias("tags"),
        md.links(chunk).alias("links"), md.tasks(chunk).alias("tasks"), md.word_count(chunk).alias("word_count"), tokenizer(chunk).alias("tokens"),
    )
    return out.withColumn("token_count", F.size("tokens")).filter(~F.col("section_path").rlike(r"(^|[/#])\.\.(/|$)"))


class SectionError(LookupError):
    """A note without the section asked for, or no such note; the message lists the sections that there are."""


def note_rows(sections_: DataFrame, note: str) -> DataFrame:
    """The sections of one note, in order."""
    return sections_.filter(F.col("note_path") == note).orderBy("ordinal")


def section_rows(sections_: DataFrame) -> DataFrame:
    """Sections as readers get them: path, text, sorted tags, links and word count."""
    return sections_.select("note_path", "ordinal", "section_path", "heading_path", "content", F.array_sort(F.array_distinct("tags")).alias("tags"), "links", "word_count")


def exists(sections_: DataFrame, note: str, heading_path: list[str] | None = None) -> bool:
    """Whether a note, or a section of it, is indexed."""
    found = sections_.filter(F.col("note_path") == note) if heading_path is None else find_section(sections_, note, heading_path)
    return not found.isEmpty()


def section_resource(sections_: DataFrame, note: str, heading_path: list[str]) -> dict:
    """One section for a reader: its path, text, sorted tags, links and word count."""
    found = section_rows(find_section(sections_, note, heading_path)).collect()
    if not found:
        known = [r["section_path"] for r in note_rows(sections_, note).select("section_path").collect()]
        raise SectionError(f"{note} has no section {'/'.join(heading_path)!r}; available: {', '.join(known) or 'none, the note is not indexed'}")
    r = found[0]
    return {"section_path": r["section_path"], "heading_path": r["heading_path"], "content": r["content"], "tags": r["tags"], "links": r["links"], "word_count": r["word_count"]}


def note_resource(files: DataFrame, note: str) -> dict:
    """One note for a reader: title, sorted tags, headings, links, figures and its text as put together again; an error if there is none."""
    one = files.filter(F.col("path") == note)
    found = notes(one).collect()
    if not found:
        raise SectionError(f"there is no note {note}")
    return found[0].asDict() | {"content": serialised(one).first()["content"]}


def serialised(files: DataFrame) -> DataFrame:
    """path and text of each note, put together again from its frontmatter block and its sections; blank pieces are lost."""
    p = parsed(files).withColumn("block", md.frontmatter_text(F.col("content")))
    head = F.coalesce(F.concat(F.lit("---\n"), "block", F.lit("\n---\n")), F.lit(""))
    return p.select("path", F.concat(head, F.array_join("chunks", "")).alias("content"))


def serialise(frontmatter: str | None, chunks: list[str]) -> str:
    """A note's text from its frontmatter block and the texts of its sections in order."""
    return (f"---\n{frontmatter}\n---\n" if frontmatter is not None else "") + "".join(chunks)


def find_section(sections_: DataFrame, note: str, heading_path: list[str]) -> DataFrame:
    """The first section of a note with exactly these headings."""
    want = F.array(*map(F.lit, heading_path)) if heading_path else F.array().cast("array<string>")
    return sections_.filter((F.col("note_path") == note) & (F.col("heading_path") == want)).orderBy("ordinal").limit(1)
