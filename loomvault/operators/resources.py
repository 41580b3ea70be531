"""Read access by URI: figures, tags and folders of a vault, notes and sections.

    <scheme>://vault/info[/<folder>]    <scheme>://vault/tags[/<folder>]    <scheme>://vault/folders[/<folder>]
    <scheme>://note/<path>              <scheme>://note/<path>#<heading>/<heading>
"""

from __future__ import annotations

from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.paths import folder_argument, is_under_folder
from . import catalog
from . import sections as sec


class ResourceError(LookupError):
    """A URI that names nothing here."""


def read(uri: str, settings: Settings, sections: DataFrame, files: DataFrame) -> Any:
    """What a URI names. sections: those of the index; files (path, content): the vault's notes."""
    _, mark, rest = uri.partition("://")
    area, _, what = rest.partition("/")
    if not mark or not what:
        raise ResourceError(uri)
    if area == "note":
        note, at, headings = unquote(what).partition("#")
        return sec.section_resource(sections, note, headings.split("/")) if at else sec.note_resource(files, note)
    view, _, where = what.partition("/")
    if area != "vault" or view not in ("info", "tags", "folders"):
        raise ResourceError(uri)
    folder = folder_argument(unquote(where))
    if view == "info":
        row = catalog.info(sections, folder).first()
        return {"name": settings.name, "folder": folder or None, "note_count": row["note_count"], "tag_count": row["tag_count"], "storage_type": settings.storage}
    below = sections.filter(is_under_folder(F.col("note_path"), folder))
    if view == "tags":
        return catalog.tag_children(catalog.tag_counts(below)).orderBy("tag")
    return catalog.folder_counts(below.select("note_path", "folder").distinct())
