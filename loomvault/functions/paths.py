"""Vault paths as Spark columns, and the same rules for a single path on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of images and their MIME types.
IMAGE_MIME = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "ico": "image/x-icon",
    "tiff": "image/tiff",
    "tif": "image/tiff",
}


class PathError(ValueError):
    """A string that is no vault path."""


def normalise(path: Column) -> Column:
    """Without leading separators, with forward slashes."""
    return F.replace(F.regexp_replace(path, r"^[/\\]+", ""), F.lit("\\"), F.lit("/"))


def file_part(path: Column) -> Column:
    return F.substring_index(path, "#", 1)


def fragment(path: Column) -> Column:
    """What follows the first `#`, or null."""
    return F.nullif(F.regexp_extract(path, r"(?s)^[^#]*#(.*)$", 1), F.lit(""))


def last_segment(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(file_part(path), r"/$", ""), "/", -1)


def extension(path: Column) -> Column:
    """The case-sensitive extension of the last segment; a leading dot begins no extension."""
    return F.nullif(F.regexp_extract(last_segment(path), r"^.+\.([^.]*)$", 1), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(last_segment(path), r"^(.+)\.[^.]*$", "$1")


def parent(path: Column) -> Column:
    """The folder of a path with its slash, null at the root."""
    p = F.regexp_replace(file_part(path), r"/$", "")
    return F.nullif(F.regexp_extract(p, r"^(.*/)[^/]+$", 1), F.lit(""))


def note_path(path: Column) -> Column:
    return file_part(path)


def kind(path: Column) -> Column:
    """root, folder, note, section, block, image or other; null for a string that is no path."""
    ext = extension(path)
    bad = path.rlike(r"(^|/)\.\.(/|$)") | (path.contains("#") & ~file_part(path).endswith(".md"))
    return (
        F.when(path == "", "root")
        .when(bad, F.lit(None).cast("string"))
        .when(path.contains("#") & F.regexp_like(path, F.lit(r"^[^#]*#\^")), "block")
        .when(path.contains("#"), "section")
        .when(path.endswith("/"), "folder")
        .when(ext == "md", "note")
        .when(ext.isin(*IMAGE_MIME), "image")
        .otherwise("other")
    )


def block_id(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^[^#]*#\^(.*)$", 1), F.lit(""))


def section_headings(path: Column) -> Column:
    """The fragment split at slashes; empty without one."""
    f = fragment(path)
    return F.when(f.isNull() | f.startswith("^"), F.array().cast("array<string>")).otherwise(F.split(f, "/"))


def is_in_folder(path: Column, folder: str) -> Column:
    return F.coalesce(parent(path) == folder, F.lit(False))


def is_under_folder(path: Column, folder: str) -> Column:
    """Anywhere below a folder (given with its slash); everything is below the root, an empty string."""
    return F.lit(True) if folder == "" else path.startswith(folder)


def mime(path: Column) -> Column:
    pairs = [x for e, m in IMAGE_MIME.items() for x in (F.lit(e), F.lit(m))]
    return F.create_map(*pairs)[extension(path)]


@dataclass(frozen=True)
class VaultPath:
    """One checked path."""

    value: str
    kind: str

    @classmethod
    def of(cls, raw: str) -> VaultPath:
        if raw == "":
            return cls("", "root")
        p = raw.lstrip("/\\").replace("\\", "/")
        if not p:
            raise PathError("an absolute root is no vault path")
        if ".." in p.split("/"):
            raise PathError(f"{raw}: `..` is not allowed")
        if "#" in p:
            note, _, rest = p.partition("#")
            if not note.endswith(".md"):
                raise PathError(f"{raw}: a section needs a note")
            if ".." in rest.split("/"):
                raise PathError(f"{raw}: `..` is not allowed")
            return cls(p, "block" if rest.startswith("^") else "section")
        if p.endswith("/"):
            return cls(p, "folder")
        name = p.rsplit("/", 1)[-1]
        ext = name.rsplit(".", 1)[1] if "." in name[1:] else ""
        return cls(p, "note" if ext == "md" else "image" if ext in IMAGE_MIME else "other")

    @property
    def stem(self) -> str:
        name = self.value.partition("#")[0].rstrip("/").rsplit("/", 1)[-1]
        return name.rsplit(".", 1)[0] if "." in name[1:] else name

    @property
    def parent(self) -> str | None:
        p = self.value.partition("#")[0].rstrip("/")
        return p.rsplit("/", 1)[0] + "/" if "/" in p else None


def folder_argument(raw: str | None) -> str:
    """A folder given by a user: slashes trimmed and one added, checked; nothing is the root."""
    p = (raw or "").strip("/")
    return VaultPath.of(p + "/").value if p else ""
