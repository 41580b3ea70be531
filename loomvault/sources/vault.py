"""Scans of a vault's files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import data_uri, paths


class AccessError(PermissionError):
    """A path outside the vault, or one that access rules forbid."""


_STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*"


def _root(root: str) -> str:
    """A URI as it is, whatever the store; a plain path as this machine resolves it."""
    return root.rstrip("/") if re.match(_STORE, root) else os.path.realpath(root)


def _relative(root: str) -> Column:
    """The vault path of a scanned file. File names come percent-encoded, and a plus sign stands for itself."""
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(full, _STORE, "/")
    return F.substring(plain, len(re.sub(_STORE, "/", _root(root)).rstrip("/")) + 2, 1 << 20)


def _facts(root: str) -> list[Column]:
    m = F.col("_metadata")
    token = F.concat(F.unix_millis(m["file_modification_time"]).cast("string"), F.lit(":"), m["file_size"].cast("string"))
    return [_relative(root).alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified"), token.alias("token")]


def _allowed(files: DataFrame, deny: Iterable[str]) -> DataFrame:
    """Without the denied paths: exact paths, not what lies below them."""
    deny = list(deny)
    if not deny:
        return files
    return files.join(files.sparkSession.createDataFrame([(p,) for p in deny], "path string"), "path", "left_anti")


def listing(spark: SparkSession, root: str, deny: Iterable[str] = ()) -> DataFrame:
    """path, size, modified, token and kind of every file below root (a path or a URI), but for names that begin with a dot or an
    underscore, which Spark's file index leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_root(root)).select(*_facts(root))
    return _allowed(files, deny).withColumn("kind", paths.kind(F.col("path")))


def notes(spark: SparkSession, root: str, deny: Iterable[str] = ()) -> DataFrame:
    """path, size, modified, token and content of every note."""
    scan = spark.read.text(_root(root), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return _allowed(scan.select(*_facts(root), F.col("value").alias("content")), deny)


def images(spark: SparkSession, root: str, deny: Iterable[str] = ()) -> DataFrame:
    """path, size, modified, token and data URI of every image."""
    glob = "*.{" + ",".join(paths.IMAGE_MIME) + "}"
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(_root(root))
    files = scan.select(*_facts(root), F.col("content"))
    return _allowed(files, deny).withColumn("uri", data_uri.encode(paths.mime(F.col("path")), F.col("content"))).drop("content")


def inside(root: str, path: str) -> str:
    """The real place of a vault path; an error where links or dots lead out of the vault."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise AccessError(f"{path} leads out of the vault")
    return full
