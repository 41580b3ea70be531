"""Listings of a vault's files as trees of folder digests, compared from the root down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import scratch
from . import changes

#: Folders that are named in a filter; more of them are joined.
NAMED = 1_000


@dataclass
class Compared:
    """Folders that were met on the way down, those whose own files differ, and the files that these hold on both sides."""

    folders: int = 0
    differing: int = 0


def _folder(path: Column) -> Column:
    return F.coalesce(paths.parent(path), F.lit(""))


def folders(files: DataFrame) -> DataFrame:
    """The tree of files (path, token): folder, above (its folder; null at the root, which is ""), own and below (digests of the files directly in it, and of
    all below it).

    A digest is the exclusive or of two 64-bit hashes of each file, and their number: it does not depend on an order, so the tree is one aggregation
    that combines before it shuffles, however many files a folder holds.
    """
    f = files.select(_folder(F.col("path")).alias("in_"), F.xxhash64("path", "token").alias("h1"), F.xxhash64("token", F.lit(1), "path").alias("h2"))
    parts = F.split(F.regexp_replace("in_", "/$", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    above = F.concat(F.array(F.lit("")), F.when(F.col("in_") != "", up).otherwise(F.array().cast("array<string>")))
    digest = lambda only: F.struct(F.bit_xor(F.when(only, F.col("h1"))).alias("a"), F.bit_xor(F.when(only, F.col("h2"))).alias("b"), F.count(F.when(only, F.lit(1))).alias("n"))
    rows = f.select("in_", "h1", "h2", F.explode(above).alias("folder"))
    tree = rows.groupBy("folder").agg(digest(F.col("in_") == F.col("folder")).alias("own"), digest(F.lit(True)).alias("below"))
    return tree.withColumn("above", F.when(F.col("folder") != "", _folder(F.regexp_replace("folder", "/$", ""))))


class Listings:
    """Numbered listings below a folder: files sorted by their folder, and the tree of digests sorted by the folder above."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, files: DataFrame) -> int:
        """Keep a listing (path, token); its number, which is all that a reader has to remember."""
        number = (scratch.states(self.spark, self.root) or [-1])[0] + 1
        kept = files.select(_folder(F.col("path")).alias("folder"), "path", "token")
        kept.repartitionByRange("folder", "path").sortWithinPartitions("folder", "path").write.parquet(f"{self.root}/files-{number}")
        tree = folders(self.files(number))
        tree.repartitionByRange("above").sortWithinPartitions("above", "folder").write.parquet(f"{self.root}/tree-{number}")
        scratch.publish(self.spark, self.root, number, {"files": f"files-{number}", "tree": f"tree-{number}"})
        return number

    def files(self, number: int) -> DataFrame:
        return self.spark.read.schema("folder string, path string, token string").parquet(f"{self.root}/files-{number}")

    def tree(self, number: int) -> DataFrame:
        digest = "struct<a:long,b:long,n:long>"
        return self.spark.read.schema(f"folder string, own {digest}, below {digest}, above string").parquet(f"{self.root}/tree-{number}")

    def _inside(self, rows: DataFrame, column: str, wanted: DataFrame, few: list[str]) -> DataFrame:
        if len(few) <= NAMED:
            return rows.filter(F.col(column).isin(*few))  # reaches the scan, which is sorted by it
        return rows.join(wanted.select(F.col("folder").alias("_folder")), F.col(column) == F.col("_folder"), "left_semi")

    def diff(self, now: int, was: int) -> tuple[DataFrame, Compared]:
        """What `changes.diff` gives for the files of two listings, and what was compared.

        From the root down, level by level, only the folders below those whose digests differ are read, and at the end only the files of
        folders whose own files differ. A folder that one listing lacks differs.
        """
        seen, a, b = Compared(), self.tree(now), self.tree(was)
        differing = None

        def level(x: DataFrame, y: DataFrame) -> DataFrame:
            x, y = x.select("folder", F.col("own").alias("own_x"), F.col("below").alias("below_x")), y.select(F.col("folder").alias("_y"), F.col("own").alias("own_y"), F.col("below").alias("below_y"))
            both = x.join(y, F.col("folder") == F.col("_y"), "full_outer").filter(~F.col("below_x").eqNullSafe(F.col("below_y")))
            path = scratch.new_path(self.spark, "level")
            both.select(F.coalesce("folder", "_y").alias("folder"), (~F.col("own_x").eqNullSafe(F.col("own_y"))).alias("own")).write.parquet(path)
            return self.spark.read.schema("folder string, own boolean").parquet(path)

        here = level(a.filter("above is null"), b.filter("above is null"))
        while True:
            seen.folders += here.count()
            own = here.filter("own").select("folder")
            differing = own if differing is None else differing.union(own)
            few = [r["folder"] for r in here.limit(NAMED + 1).collect()]
            if not few:
                break
            here = level(self._inside(a, "above", here, few), self._inside(b, "above", here, few))
        few = [r["folder"] for r in differing.limit(NAMED + 1).collect()]
        seen.differing = differing.count()
        x, y = (self._inside(self.files(n), "folder", differing, few).select("path", "token") for n in (now, was))
        return changes.diff(x, y), seen
