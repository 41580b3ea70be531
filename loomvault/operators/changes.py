"""Changes between a listing of files and the revisions known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """op (created, updated, deleted), path and token of every difference between files and revisions (path, token)."""
    a, b = files.select("path", F.col("token").alias("now")), revisions.select("path", F.col("token").alias("was"))
    op = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "deleted").otherwise("updated")
    return a.join(b, "path", "full_outer").filter(~F.col("now").eqNullSafe(F.col("was"))).select(op.alias("op"), "path", F.col("now").alias("token"))


def last_events(events: DataFrame, key: str = "path", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last event of each key; combined before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(key, "e.*")


def apply(state: DataFrame, events: DataFrame, key: str = "path", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """state with the last event of each key: deletions gone, others with the event's columns. Applying it twice changes nothing.

    Events without the columns of `order` (a difference of two listings) have one event for each key.
    """
    last = last_events(events, key, order) if set(order) <= set(events.columns) else events
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("op <> 'deleted'").select(*state.columns))
