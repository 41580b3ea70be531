"""A table of rows by key, kept as levels of runs: a batch writes its own rows only, and a reader takes the last row of each key."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import scratch
from .changes import last_events

#: Runs of a level that are merged into one of the next.
FAN = 4


class Keyed:
    """Rows by `key`; of equal keys the one with the highest `order` is the row, of equal ones the later batch's.

    Batches are numbered, and a numbered file names the runs after each: a state is there whole or not at all. FAN runs of a level are merged into
    one of the next, so each row is written once a level, and a reader meets fewer than FAN runs on each. The last row of a key is taken
    by an aggregation that combines before it shuffles.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, order: tuple[str, ...]):
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), key, order
        self.schema = StructType.fromDDL(schema)
        self.columns = self.schema.names

    def meta(self) -> tuple[int, dict]:
        """Number of the last batch and the state after it; -1 before the first."""
        n, meta = scratch.latest(self.spark, self.root)
        return n, meta or {"runs": []}

    def _read(self, run: dict) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{run['path']}").withColumn("_seq", F.lit(run["seq"]))

    def _last(self, runs: list[dict], needed: dict[str, Column] | None = None) -> DataFrame:
        """The last row of each key in some runs; needed: only these columns besides the key, made before rows move."""
        rows = functools.reduce(DataFrame.unionByName, map(self._read, runs)) if runs else self.spark.createDataFrame([], self.schema).withColumn("_seq", F.lit(0))
        if needed is None:
            return last_events(rows, self.key, (*self.order, "_seq")).select(*self.columns)
        order = [F.col(c).alias(f"_by_{c}") for c in self.order]
        rows = rows.select(self.key, *order, "_seq", *[c.alias(name) for name, c in needed.items()])
        return last_events(rows, self.key, (*[f"_by_{c}" for c in self.order], "_seq")).select(self.key, *needed)

    def read(self, since: int | None = None, needed: dict[str, Column] | None = None) -> DataFrame:
        """The last row of each key; since: only of what later batches have brought, rounded to whole runs; needed: see `_last`."""
        runs = self.meta()[1]["runs"]
        return self._last([r for r in runs if since is None or r["seq"] > since], needed)

    def write(self, rows: DataFrame) -> str:
        """A part with these rows, which no state names yet."""
        path = f"rows-{uuid.uuid4().hex}"
        rows.select(*self.columns).write.parquet(f"{self.root}/{path}")
        return path

    def _levelled(self, runs: list[dict]) -> list[dict]:
        while True:
            level = next((v for v in sorted({r["level"] for r in runs}) if sum(r["level"] == v for r in runs) >= FAN), None)
            if level is None:
                return runs
            some = [r for r in runs if r["level"] == level]
            merged = {"seq": some[-1]["seq"], "level": level + 1, "path": self.write(self._last(some))}
            runs = [r for r in runs if r["level"] > level] + [merged] + [r for r in runs if r["level"] < level]

    def publish(self, number: int, path: str | None, runs: list[dict], more: dict | None = None) -> None:
        """Make the state after batch `number` current: these runs and a new one. Refused where another writer has published that number."""
        new = [*runs, {"seq": number, "level": 0, "path": path}] if path else list(runs)
        scratch.publish(self.spark, self.root, number, {"runs": self._levelled(new)} | (more or {}))

    def merge(self, batch: DataFrame, number: int) -> None:
        """Add a numbered batch, reduced to the last row of each key. One that has been added is not added again, so a restart may repeat it."""
        done, meta = self.meta()
        if number > done:
            last = last_events(batch.select(*self.columns), self.key, self.order)
            self.publish(number, self.write(last), meta["runs"])

    def parts(self) -> int:
        return len(self.meta()[1]["runs"])
