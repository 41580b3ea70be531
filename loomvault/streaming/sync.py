"""Live synchronisation: a stream of file changes, and a keyed state that follows it.

Spark's file source reports neither modified nor deleted files, so the source here lists the vault for each micro-batch and reports the
difference from the listing before, which is its offset's state.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..operators import changes
from ..operators.keyed import Keyed

EVENTS = "op string, path string, token string, ts timestamp"


def snapshot(root: str) -> dict[str, str]:
    """path -> token of every file."""
    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            full = os.path.join(folder, name)
            try:
                s = os.stat(full)
            except OSError:
                continue
            out[os.path.relpath(full, root).replace(os.sep, "/")] = f"{s.st_mtime_ns // 1_000_000}:{s.st_size}"
    return out


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"seen": "{}"}

    def _events(self, before: dict[str, str], now: dict[str, str]) -> Iterator[tuple]:
        from datetime import UTC, datetime

        ts = datetime.fromtimestamp(time.time(), UTC)
        for p in sorted(now):
            if p not in before:
                yield ("created", p, now[p], ts)
            elif before[p] != now[p]:
                yield ("updated", p, now[p], ts)
        for p in sorted(before.keys() - now.keys()):
            yield ("deleted", p, None, ts)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = snapshot(self.root)
        return iter(list(self._events(json.loads(start["seen"]), now))), {"seen": json.dumps(now, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self._events(json.loads(start["seen"]), json.loads(end["seen"]))))


class VaultChanges(DataSource):
    """readStream.format("vault_changes").option("path", root)."""

    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])


def watch(spark: SparkSession, root: str) -> DataFrame:
    """The stream of changes below root."""
    spark.dataSource.register(VaultChanges)
    return spark.readStream.format("vault_changes").option("path", root).load()


def follow(stream: DataFrame, apply_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Hand each micro-batch, reduced to the last event of each path, to apply_batch."""

    def run(batch: DataFrame, number: int) -> None:
        apply_batch(changes.last_events(batch, "path", ("ts",)), number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class KeyedState(Keyed):
    """The last event of each key, as a table that micro-batches are merged into: a batch writes what it holds, whatever the state's size.

    A restart goes on from the highest complete batch, and a batch that has been applied is not applied again.
    """
