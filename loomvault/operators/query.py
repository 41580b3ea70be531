"""The search language: words, quoted phrases, `tag:` and `folder:` filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.paths import PathError, VaultPath

# Fixed value: the tokens of a query, in the order in which they are tried.
TOKEN = re.compile(r"""tag:"([^"]*)"?|tag:(\S+)|folder:"([^"]*)"?|folder:(\S+)|"([^"]*)"?|(\S+)""")


class QueryError(ValueError):
    """A folder filter that is no path."""


@dataclass(frozen=True)
class SearchQuery:
    text: str = ""
    tags: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.text.strip() or self.tags or self.folders)


#: What each group of TOKEN adds to; exactly one takes part in a match.
FIELDS = (None, "tags", "tags", "folders", "folders", "text", "text")


def _folder(raw: str) -> str:
    try:
        return VaultPath.of(raw.rstrip("/") + "/" if raw.strip("/") else raw).value
    except PathError as e:
        raise QueryError(f"folder filter {raw!r}: {e}") from e


def parse(raw: str) -> SearchQuery:
    """The query that a string means. Filters without a name are none; an empty phrase is an empty word."""
    found: dict[str, list[str]] = {"text": [], "tags": [], "folders": []}
    for m in TOKEN.finditer(raw):
        found[FIELDS[m.lastindex]].append(m[m.lastindex])
    named = {k: list(filter(None, v)) for k, v in found.items() if k != "text"}
    return SearchQuery(" ".join(found["text"]), named["tags"], [_folder(f) for f in named["folders"]])
