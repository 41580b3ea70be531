"""A versioned log of commits: batches of writes to notes, checked against the revisions that their writers have read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from .edits import Conflict, apply_writes
from .keyed import Keyed

#: A writer's attempts to be first with a version.
ATTEMPTS = 20
APPLIED = ("created", "updated", "deleted")


class Log:
    """Notes by path in numbered versions.

    A write names the revision that it expects, null for a note that must not exist; content null deletes. Each version is one batch, there whole or
    not at all. Writers need no lock: a batch is checked against the current version and published as the next one; if another writer has published
    that, the batch is checked again against what has come since. Revisions are `version:bytes`, so a revision never comes back.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.rows = Keyed(spark, root, "path string, token string, content string, version long", "path", ("version",))

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        return max(0, self.rows.meta()[0])

    def notes(self) -> DataFrame:
        """path, content and token of every note."""
        return self.rows.read().filter("content is not null").select("path", "content", "token")

    def revisions(self) -> DataFrame:
        """path and token of every note: what a listing of its files would give."""
        known = self.rows.read(needed={"token": F.col("token"), "there": F.col("content").isNotNull()})
        return known.filter("there").select("path", "token")  # no content moves

    def changes(self, since: int) -> DataFrame:
        """op, path and token of the notes that versions after `since` have written; only runs with such versions are read."""
        op = F.when(F.col("content").isNull(), "deleted").otherwise("written")
        rows = self.rows.read(since, {"op": op, "token": F.col("token"), "version": F.col("version")})
        return rows.filter(F.col("version") > since).select("op", "path", "token")

    def _outcomes(self, writes: DataFrame) -> DataFrame:
        """path and outcome of writes (path, expected, deletes): created, updated, deleted; exists, missing, conflict; or repeated, if a batch writes a path twice."""
        checked = apply_writes(writes, self.revisions())
        times = writes.groupBy(F.col("path").alias("_path")).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
        outcome = F.when(F.col("_times").isNotNull(), "repeated").when((F.col("outcome") == "updated") & F.col("deletes"), "deleted").when((F.col("outcome") == "created") & F.col("deletes"), "missing").otherwise(F.col("outcome"))
        return checked.join(times, F.col("path").eqNullSafe(F.col("_path")), "left").select("path", outcome.alias("outcome"))

    def commit(self, writes: DataFrame, atomic: bool = False) -> tuple[int, DataFrame]:
        """Write a batch (path, expected, content): the version and (path, outcome) of each write.

        Writes whose expectation fails change nothing, and the others are written; atomic: one that fails fails all (Conflict). A
        batch of which nothing is written makes no version. The outcomes are those against the version that the batch followed.

        The batch is written once, as the version's rows; it is checked by paths and revisions alone, and only where some writes fail are the others written anew.
        """
        for _ in range(ATTEMPTS):
            done, meta = self.rows.meta()
            number = max(0, done) + 1
            kept, draft = f"{self.rows.root}/outcomes-{uuid.uuid4().hex}", f"rows-{uuid.uuid4().hex}"
            size = F.octet_length(F.coalesce("content", F.lit(""))).cast("string")
            token = F.concat(F.lit(f"{number}:"), size).alias("token")
            writes.select("path", token, "content", F.lit(number).cast("long").alias("version"), F.col("expected").cast("string").alias("expected")).write.parquet(f"{self.rows.root}/{draft}")
            batch = self.spark.read.schema("path string, token string, content string, version long, expected string").parquet(f"{self.rows.root}/{draft}")
            self._outcomes(batch.select("path", "expected", F.col("content").isNull().alias("deletes"))).write.parquet(kept)
            outcomes = self.spark.read.schema("path string, outcome string").parquet(kept)
            good = outcomes.filter(F.col("outcome").isin(*APPLIED))
            failed = outcomes.filter(~F.col("outcome").isin(*APPLIED))
            fails = not failed.isEmpty()
            if fails and atomic:
                self._remove(draft)
                raise Conflict(", ".join(f"{r['path']}: {r['outcome']}" for r in failed.limit(5).collect()))
            if good.isEmpty():
                self._remove(draft)
                return number - 1, outcomes
            path = draft
            if fails:  # all writes of a path fail or none does
                bad = failed.select(F.col("path").alias("_path")).distinct()
                path = self.rows.write(batch.join(bad, F.col("path").eqNullSafe(F.col("_path")), "left_anti"))
                self._remove(draft)
            try:
                self.rows.publish(number, path, meta["runs"])
                return number, outcomes
            except scratch.Overtaken:
                self._remove(path)
                continue
        raise scratch.Overtaken(f"{ATTEMPTS} attempts, and each time another writer came first")

    def _remove(self, path: str) -> None:
        fs, at = scratch.file_system(self.spark, f"{self.rows.root}/{path}")
        fs.delete(at, True)
