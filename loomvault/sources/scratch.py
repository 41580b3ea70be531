"""The folder that driver and executors share, and small numbered files in it that make a written state current."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it names none, as in a local test, one of our own.

    A cluster has no folder of one machine that all can read, so there the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = "file://" + tempfile.mkdtemp(prefix="loomvault-")
            spark.sparkContext.setCheckpointDir(_own[key])
        at = _own[key]
    return at.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _drop(spark: SparkSession, path: str) -> None:
    try:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # the session has ended; its folder goes with it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/loomvault-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


class Overtaken(RuntimeError):
    """Another writer has published a state of this number."""


def states(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the state files below root, the highest first."""
    fs, p = file_system(spark, root)
    if not fs.exists(p):
        return []
    return sorted((int(m[1]) for s in fs.listStatus(p) if (m := re.fullmatch(r"state-([0-9]+)\.json", s.getPath().getName()))), reverse=True)


def state(spark: SparkSession, root: str, n: int) -> dict | None:
    """Content of state n; None if it was broken off while it was written."""
    fs, p = file_system(spark, f"{root}/state-{n}.json")
    stream = fs.open(p)
    raw = bytes(stream.readAllBytes())
    stream.close()
    try:
        return json.loads(raw)
    except ValueError:
        return None


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the highest complete state file below root; -1 and nothing without one."""
    for n in states(spark, root):
        if (found := state(spark, root, n)) is not None:
            return n, found
    return -1, {}


def publish(spark: SparkSession, root: str, n: int, state: dict) -> None:
    """Make `state` number n. It appears whole, by a rename to a new name; nothing that is current is ever removed before."""
    fs, draft = file_system(spark, f"{root}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if not fs.rename(draft, file_system(spark, f"{root}/state-{n}.json")[1]):
        fs.delete(draft, False)
        raise Overtaken(f"state {n} of {root} has been written by another")
