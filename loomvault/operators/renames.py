"""Many renames at once: a table of renames is composed, and links are rewritten in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.scratch import new_path

# Fixed value: a wikilink's beginning, as `edits.link_pattern` has it for one stem: folders, stem, and what follows.
LINK = r"\[\[((?:[^\]\[|#/]*/)*+)([^\]\[|#/]*)(?=\]\]|#|\|)"


def _stash(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "renames")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def composed(renames: DataFrame) -> DataFrame:
    """old, new: where each name that `renames` (step, old, new) takes away has gone in the end, when they are done in the order of their steps.

    Each rename is followed by the next one of the name that it made, if the name is renamed again before it is made anew. Chains of these are
    as long as they like (a swap is one of three): pointers are doubled, so rounds follow the logarithm of the longest chain. A name may come back to
    itself. Of equal steps any comes first; a rename to the same name is none.
    """
    real = _stash(renames.filter("old <> new").select(F.col("step").cast("long").alias("step"), "old", "new").withColumn("id", F.monotonically_increasing_id()))
    order = lambda: Window.partitionBy("name").orderBy("step", "id", "leaves")
    leave = real.select(F.col("old").alias("name"), "step", "id", F.lit(1).alias("leaves"))
    arrive = real.select(F.col("new").alias("name"), "step", "id", F.lit(0).alias("leaves"))
    seen = leave.unionByName(arrive).withColumn("next", F.lead(F.struct("leaves", "id")).over(order()))
    followed = seen.filter("leaves = 0").select("id", F.when(F.col("next.leaves") == 1, F.col("next.id")).alias("to"))
    first = real.groupBy("old").agg(F.min(F.struct("step", "id")).alias("f")).select(F.col("f.id").alias("id"))
    pointers = _stash(followed.withColumn("to", F.coalesce("to", "id")))
    while True:
        far = pointers.select(F.col("id").alias("to"), F.col("to").alias("far"))
        new = _stash(pointers.join(far, "to").select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        if new.filter("moved").isEmpty():
            break
        pointers = new.select("id", "to")
    ends = real.select(F.col("id").alias("to"), F.col("new").alias("end"))
    begun = first.join(pointers, "id").join(real.select("id", "old"), "id").join(ends, "to")
    return begun.select("old", F.col("end").alias("new"))


def _last_links(renames: DataFrame) -> DataFrame:
    """renames of stems: as renames of paths, without those that only change the folder."""
    return renames.select("step", paths.stem(F.col("old")).alias("old"), paths.stem(F.col("new")).alias("new"))


def rename_many(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """notes (path, content) under their new paths and with links rewritten: path, old_path, content, n_links (links that changed).

    What a series of single renames in the order of their steps makes of paths and links, links being known by their stems alone. One
    pass: a note's links are found by their places, joined to the composed stems, and put back, so a swap is a swap. Renames of
    paths that no note has change links only.
    """
    moves = composed(renames).toDF("m_old", "m_new")
    stems = composed(_last_links(renames)).toDF("s_old", "s_new")
    found = notes.select(F.col("path").alias("old_path"), "content", F.regexp_extract_all("content", F.lit(LINK), F.lit(2)).alias("stems"))
    links = found.select("old_path", F.posexplode("stems").alias("at", "stem"))
    hit = links.join(stems, F.col("stem") == F.col("s_old")).groupBy("old_path").agg(F.map_from_entries(F.collect_list(F.struct("at", "s_new"))).alias("to"))
    out = found.join(hit, "old_path", "left").join(moves, F.col("old_path") == F.col("m_old"), "left")
    content = F.when(F.col("to").isNull(), F.col("content")).otherwise(_spliced(F.col("content"), F.col("to")))
    return out.select(F.coalesce("m_new", "old_path").alias("path"), "old_path", content.alias("content"), F.coalesce(F.size("to"), F.lit(0)).alias("n_links"))


def _spliced(content: Column, to: Column) -> Column:
    """content with the i-th link's folders and stem replaced by what `to` has for i."""
    parts, whole = F.split(content, LINK, -1), F.regexp_extract_all(content, F.lit(LINK), F.lit(0))
    bind = lambda p, w: F.transform(F.arrays_zip(p.alias("p"), w.alias("w")), lambda x, i: F.concat(x["p"], F.coalesce(F.concat(F.lit("[["), F.element_at(to, i)), x["w"], F.lit(""))))
    return F.array_join(bind(parts, whole), "")
