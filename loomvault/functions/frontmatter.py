"""Frontmatter as full YAML: a vectorised pandas UDF for columns, and plain functions for one note."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = re.compile(r"\A---\r?\n(.*?)\r?\n---\r?\n?", re.DOTALL)


class FrontmatterError(ValueError):
    """YAML that does not parse, or a typed key of another type."""


class _Loader(yaml.SafeLoader):
    """YAML with null, booleans, integers and floats only: dates stay strings, and so do yes and no."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*)$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789"),
):
    for _c in [*_first, *([""] if _tag == "null" else [])]:
        _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), [_c])

TYPED = ("title", "description", "tags", "aliases")
EMPTY: dict[str, Any] = {"title": None, "description": None, "tags": [], "aliases": [], "custom": {}}


def split(content: str) -> tuple[str | None, str]:
    """(the block without carriage returns, or None; the rest of the note)."""
    m = _BLOCK.match(content)
    return (m.group(1).replace("\r", ""), content[m.end() :]) if m else (None, content)


def parse(block: str) -> dict[str, Any]:
    """Typed keys and the rest; an error for bad YAML or a typed key of another type."""
    try:
        data = yaml.load(block, Loader=_Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise FrontmatterError(str(e)) from e
    if data is None:
        return {**EMPTY, "tags": [], "aliases": [], "custom": {}}
    if not isinstance(data, dict):
        raise FrontmatterError("not a mapping")
    out: dict[str, Any] = {"custom": {str(k): v for k, v in data.items() if k not in TYPED}}
    for k in ("title", "description"):
        v = data.get(k)
        if v is not None and not isinstance(v, str):
            raise FrontmatterError(f"{k} must be a string")
        out[k] = v
    for k in ("tags", "aliases"):
        v = data.get(k) if data.get(k) is not None else []
        if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
            raise FrontmatterError(f"{k} must be a list of strings")
        out[k] = v
    return out


def parse_lenient(block: str) -> dict[str, Any]:
    """As parse, but an error empties the whole frontmatter."""
    try:
        return parse(block)
    except FrontmatterError:
        return {**EMPTY, "tags": [], "aliases": [], "custom": {}}


def dump(fm: dict[str, Any]) -> str:
    """The block with its fences."""
    data: dict[str, Any] = {k: fm[k] for k in ("title", "description") if fm.get(k) is not None}
    data |= {k: fm[k] for k in ("tags", "aliases") if fm.get(k)}
    data |= fm.get("custom", {})
    text = yaml.safe_dump(data, allow_unicode=True, sort_keys=False, default_flow_style=False) if data else "{}\n"
    return f"---\n{text.rstrip(chr(10))}\n---"


def patch(fm: dict[str, Any], set_: dict[str, Any] | None = None, remove: list[str] | None = None) -> dict[str, Any]:
    """Keys removed first, then set; typed keys keep their type."""
    flat = {k: v for k, v in fm.items() if k != "custom" and v not in (None, [])} | dict(fm.get("custom", {}))
    for k in remove or []:
        flat.pop(k, None)
    flat |= set_ or {}
    return parse(yaml.safe_dump(flat, allow_unicode=True, sort_keys=False))


SCHEMA = T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if k in ("tags", "aliases") else T.StringType()) for k in ("title", "description", "tags", "aliases", "custom", "error")])


@F.pandas_udf(SCHEMA)
def frontmatter(blocks: pd.Series) -> pd.DataFrame:
    """Parsed leniently, with the strict parser's error beside it; custom keys as JSON. Null where there is no block."""
    rows = []
    for b in blocks:
        if b is None:
            rows.append((None, None, [], [], "{}", None))
            continue
        try:
            fm, error = parse(b), None
        except FrontmatterError as e:
            fm, error = parse_lenient(b), str(e)
        rows.append((fm["title"], fm["description"], fm["tags"], fm["aliases"], json.dumps(fm["custom"], ensure_ascii=False, default=str), error))
    return pd.DataFrame(rows, columns=["title", "description", "tags", "aliases", "custom", "error"])
