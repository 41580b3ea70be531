"""Markdown notes as Spark columns: frontmatter, sections, headings, links, tags and tasks.

Everything here is a built-in expression or a higher-order function over arrays, so a scan of notes stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the note format. (?U) makes \w and \s Unicode, (?d) makes \n the only line end.
FRONTMATTER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
HEADING = r"(?mdU)^(#{1,6})\s+(.+?)(?:\s+#+)?$"
WIKILINK = r"(!?)\[\[([^#|^\]\n]*)(?:#([^^|#\]\n]*))?(?:#?\^([^|\]\n]*))?(?:\|([^\]\n]*))?\]\]"
MARKDOWN_LINK = r"""(?U)(!?)\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)"""
URL = r"(?U)<([a-zA-Z][a-zA-Z0-9+.-]*://[^\s>]+)>"
EMAIL = r"(?U)<([^\s@>]+@[^\s>]+)>"
CODE = r"```[\s\S]*?```|``[^`]+``|`[^`]+`"
ANY_WIKILINK = r"\[\[[^\]]+\]\]"
TAG = r"(?U)#([\w/_-]+)"
TAG_WHOLE = r"(?U)^#[\w/_-]+$"
TASK = r"(?d)^[\t ]*- \[(.)\](?U)\s*(.*)$"

LINK_TYPE = "struct<kind:string,target:string,alias:string,heading:string,block_ref:string,text:string,title:string,is_embed:boolean>"


def frontmatter_text(content: Column) -> Column:
    """The raw block without carriage returns, or null."""
    return F.when(content.rlike(FRONTMATTER), F.replace(F.regexp_extract(content, FRONTMATTER, 1), F.lit("\r"), F.lit("")))


def body(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def plain_frontmatter(block: Column) -> Column:
    """Title and tags of a block of plain `key: value` lines and `- item` lists. For other YAML see functions.frontmatter."""
    title = F.nullif(F.trim(F.regexp_extract(block, r"(?md)^title:[ ]*(.*)$", 1)), F.lit(""))
    lines = F.regexp_extract(F.concat(block, F.lit("\n")), r"(?md)^tags:[ ]*\n((?:[ ]*- .*\n)*+)", 1)  # possessive: a loop, where a list of any length needs no stack
    tags = F.regexp_extract_all(lines, F.lit(r"(?md)^[ ]*- (.*)$"), F.lit(1))
    return F.struct(title.alias("title"), F.coalesce(F.transform(tags, lambda t: F.trim(t)), F.array().cast("array<string>")).alias("tags"))


def chunks(text: Column) -> Column:
    """The text cut before every heading, without blank pieces."""
    cut = F.split(F.regexp_replace(text, HEADING, "\x01$0"), "\x01")
    return F.filter(cut, lambda c: c.rlike(r"(?U)\S"))


def heading(chunk: Column) -> Column:
    """Level and text of the heading in a chunk's first line; null without one."""
    line = F.element_at(F.split(chunk, r"\r?\n", 2), 1)  # the rest is not cut
    text = F.regexp_extract(line, HEADING, 2)
    return F.when(text != "", F.struct(F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), text.alias("text")))


def heading_paths(headings: Column) -> Column:
    """For each heading of a note in order, the texts of those above it and its own; empty where there is none.

    A heading closes all of its level or deeper. The open ones always rise in level, so closing is a filter. One fold carries the open
    headings and the paths so far.
    """
    start = F.struct(F.array().cast("array<struct<level:int,text:string>>").alias("open"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc: Column, h: Column) -> Column:
        now = F.when(h.isNull(), acc["open"]).otherwise(F.concat(F.filter(acc["open"], lambda x: x["level"] < h["level"]), F.array(h)))
        path = lambda open_: F.when(h.isNull(), F.array().cast("array<string>")).otherwise(F.transform(open_, lambda x: x["text"]))
        return F.get(F.transform(F.array(now), lambda o: F.struct(o.alias("open"), F.concat(acc["paths"], F.array(path(o))).alias("paths"))), F.lit(0))

    return F.aggregate(headings, start, step, lambda acc: acc["paths"])


def _null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Groups 1 to n of each match: the text is searched once, and a match's groups are taken from the match alone."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(*[F.regexp_extract(m, pattern, i).alias(f"g{i}") for i in range(1, n + 1)]))


def _link(kind: str, target: Column, alias: Column | None = None, heading_: Column | None = None, block: Column | None = None, text: Column | None = None, title: Column | None = None, embed: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    fields = {"kind": F.lit(kind), "target": target, "alias": alias, "heading": heading_, "block_ref": block, "text": text, "title": title}
    cols = [(none if c is None else c).alias(k) for k, c in fields.items()]
    return F.struct(*cols, (F.lit(False) if embed is None else embed).alias("is_embed")).cast(LINK_TYPE)


def _holding(text: Column, mark: str, found: Column, item: str) -> Column:
    """What is found in a text, which is searched only if it holds what stands in every match."""
    return F.when(~text.contains(mark), F.array().cast(f"array<{item}>")).otherwise(found)


def wikilinks(text: Column) -> Column:
    return F.transform(_groups(text, WIKILINK, 5), lambda g: _link("wiki", g["g2"], alias=_null(g["g5"]), heading_=_null(g["g3"]), block=_null(g["g4"]), embed=g["g1"] == "!"))


def markdown_links(text: Column) -> Column:
    return F.transform(_groups(text, MARKDOWN_LINK, 4), lambda g: _link("markdown", g["g3"], text=g["g2"], title=_null(g["g4"]), embed=g["g1"] == "!"))


def urls(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(1)), lambda u: _link("url", u))


def emails(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(1)), lambda u: _link("email", u))


def links(text: Column) -> Column:
    """All distinct links of a section."""
    each = (("[[", wikilinks), ("](", markdown_links), ("://", urls), ("@", emails))
    return F.array_distinct(F.concat(*[_holding(text, mark, find(text), LINK_TYPE) for mark, find in each]))


def link_text(link: Column) -> Column:
    """A link as it is written."""
    wiki = F.concat(
        F.lit("[["), link["target"],
        F.coalesce(F.concat(F.lit("#"), link["heading"]), F.lit("")),
        F.coalesce(F.concat(F.lit("#^"), link["block_ref"]), F.lit("")),
        F.coalesce(F.concat(F.lit("|"), link["alias"]), F.lit("")), F.lit("]]"),
    )
    md = F.concat(F.lit("["), link["text"], F.lit("]("), link["target"], F.coalesce(F.concat(F.lit(' "'), link["title"], F.lit('"')), F.lit("")), F.lit(")"))
    mark = F.when(link["is_embed"], F.lit("!")).otherwise(F.lit(""))
    return F.when(link["kind"] == "wiki", F.concat(mark, wiki)).when(link["kind"] == "markdown", F.concat(mark, md)).otherwise(F.concat(F.lit("<"), link["target"], F.lit(">")))


def parse_link(text: Column) -> Column:
    """The one link that a string is, as a wikilink, a Markdown link, a web address or an e-mail address in this order; else null."""
    whole = lambda pattern: text.rlike(rf"\A(?:{pattern})\z")
    first = lambda found: F.get(found, F.lit(0))
    out = F.when(whole(WIKILINK), first(wikilinks(text))).when(whole(MARKDOWN_LINK), first(markdown_links(text)))
    return out.when(whole(URL), first(urls(text))).when(whole(EMAIL), first(emails(text)))


def link_info(link: Column) -> Column:
    return F.struct(link["kind"].alias("link_type"), link["target"].alias("target"), F.when(link["kind"] == "wiki", link["alias"]).when(link["kind"] == "markdown", link["text"]).alias("display"))


def tags(text: Column) -> Column:
    """Distinct inline tags, sorted. Code and wikilinks hold none; a name of digits alone is none."""
    plain = F.when(text.contains("`"), F.regexp_replace(text, CODE, "")).otherwise(text)
    clean = F.when(text.contains("[[") | text.contains("`"), F.regexp_replace(plain, ANY_WIKILINK, "")).otherwise(plain)  # code that goes may leave one
    found = F.regexp_extract_all(clean, F.lit(TAG), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.rlike(r"^[0-9]+$"))))


def is_tag(text: Column) -> Column:
    return text.rlike(TAG_WHOLE) & ~text.rlike(r"^#[0-9]+$")


def tasks(text: Column, offset: int = 0) -> Column:
    """Check-box items: line (from `offset`), status, marker, text."""
    lines = F.split(text, r"\r?\n")
    numbered = F.transform(lines, lambda line, i: F.struct((i + offset).alias("line"), line.alias("raw")))
    hit = F.filter(numbered, lambda x: x["raw"].rlike(TASK))

    def task(x: Column) -> Column:
        marker = F.regexp_extract(x["raw"], TASK, 1)
        status = F.when(marker == " ", "open").when(marker.isin("x", "X"), "done").when(marker == "-", "canceled").otherwise("custom")
        return F.struct(x["line"].cast("int").alias("line"), status.alias("status"), marker.alias("marker"), F.regexp_extract(x["raw"], TASK, 2).alias("text"))

    return F.transform(hit, task)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))
