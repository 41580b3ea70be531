"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at VNODES points of a 64-bit ring; a document's point is the hash of its doc_id, and the arc it lies on
belongs to the next virtual node clockwise. A shard takes at most its quota of rows (numbers of rows over shards differ
by one at most): first the documents of its own arcs, and what a full shard refuses continues clockwise to the next virtual node
whose shard has room. So balance is guaranteed, and with one more shard only the new arcs and overflow move.

The ring is cut into CELLS equal cells and at the virtual nodes. Only counts by piece of the ring reach the driver (CELLS +
shards * VNODES rows at most, and one for every PIECE rows of larger pieces), where the walk is done on counts; a document then finds its shard from its rank in
its piece. Texts are never shuffled, only their sizes and checksums.

Defined results: a null text has size 1 and checksum 0; a null doc_id is placed by its text; equal doc_ids share a point and may be
split between neighbouring shards by a quota; repeated rows are placed each, in either order; very long texts count by their size alone; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, stash

SHARDS = 16
VNODES = 128
#: Equal cells of the ring: the pieces by which documents are ranked, so none is long at any scale that rows reach.
CELLS = 8192
#: Rows of one piece that a task ranks. A piece of more is cut by a hash of its rows, and more rows than that which are equal by a row number,
#: which tells apart none but them: where a row goes never depends on how the files were split.
PIECE = 1_000_000


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) of the virtual nodes, by point (signed 64-bit). A further shard adds points and moves none."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(counts: list[tuple[int, int, int]], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each piece of the ring go. counts: (piece, index of its virtual node, rows), clockwise.

    Gives (piece, first rank, end rank, shard, slot of the first): own arcs first, then overflow clockwise into what room is left.
    """
    room, used = list(room), [0] * len(room)
    placed, over = [], {}
    for piece, node, n in counts:
        shard = nodes[node][1]
        take = min(n, room[shard])
        if take:
            placed.append((piece, 0, take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        if take < n:
            over.setdefault(node, []).append((piece, take, n))
    queue: list[tuple[int, int, int]] = []
    for step in range(2 * len(nodes)):  # the second lap takes what the first carried past the end
        node = step % len(nodes)
        shard = nodes[node][1]
        while queue and room[shard]:
            piece, lo, hi = queue[0]
            take = min(hi - lo, room[shard])
            placed.append((piece, lo, lo + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            if lo + take == hi:
                queue.pop(0)
            else:
                queue[0] = (piece, lo + take, hi)
        if step < len(nodes):
            queue += over.get(node, [])
    return placed


#: Bits of a piece's number for its parts, and for the parts of equal rows.
_BITS = 20


def _cut(located: DataFrame) -> DataFrame:
    """located with the pieces' final numbers: piece, part by the row's hash, part of equal rows."""
    spark, count = located.sparkSession, F.count(F.lit(1)).alias("n")
    parts = lambda df: [(*r[:-1], -(-r["n"] // PIECE)) for r in df.filter(F.col("n") > PIECE).collect()]  # noqa: E731  one for PIECE rows at most
    cuts = F.broadcast(spark.createDataFrame(parts(located.groupBy("piece").agg(count)), "c_piece int, parts int"))
    equal = parts(located.join(cuts, F.col("piece") == F.col("c_piece")).groupBy("point", "text_crc32", "size").agg(count))
    many = F.broadcast(spark.createDataFrame(equal, "e_point long, e_crc long, e_size long, e_parts int"))
    out = located.join(cuts, F.col("piece") == F.col("c_piece"), "left").join(many, (F.col("point") == F.col("e_point")) & (F.col("text_crc32") == F.col("e_crc")) & (F.col("size") == F.col("e_size")), "left")
    part = F.pmod(F.xxhash64("point", "text_crc32", "size"), F.coalesce("parts", F.lit(1)))
    inner = F.pmod(F.xxhash64("rid"), F.coalesce("e_parts", F.lit(1)))
    number = F.shiftleft(F.shiftleft(F.col("piece").cast("long"), _BITS) + part, _BITS) + inner
    return out.withColumn("piece", number).select(*located.columns)


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    doc = F.col("doc_id").cast("long")
    checksum = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    facts = docs.select(doc.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), checksum.alias("text_crc32"))
    point = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("null"), F.col("text_crc32"), F.col("size"))).otherwise(F.xxhash64("doc_id"))
    nodes = ring(shards, vnodes)
    width = 2**64 // CELLS
    # a piece's number is its cell times the most virtual nodes in a cell, plus the nodes of the cell below its point
    by_cell: dict[int, list[int]] = {}
    for p, _ in nodes:
        by_cell.setdefault((p + 2**63) // width, []).append(p)
    most = max(map(len, by_cell.values())) + 1
    shift = (CELLS - 1).bit_length()
    cell = (F.shiftrightunsigned(F.col("point"), 64 - shift).cast("int") + F.lit(CELLS // 2)) % F.lit(CELLS)
    inner = spark.createDataFrame([(c, sorted(ps)) for c, ps in by_cell.items()], "i_cell int, marks array<long>")
    located = facts.withColumn("point", point).withColumn("cell", cell).join(F.broadcast(inner), F.col("cell") == F.col("i_cell"), "left")
    below = F.coalesce(F.size(F.filter("marks", lambda m: m < F.col("point"))), F.lit(0))
    located = located.withColumn("piece", F.col("cell") * F.lit(most) + F.when(F.col("marks").isNull(), 0).otherwise(below)).drop("i_cell", "marks", "cell")
    located = stash(located.withColumn("rid", F.monotonically_increasing_id()), "located")
    located = _cut(located).drop("rid")
    tally = {r["piece"]: r["n"] for r in located.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()}
    points = [p for p, _ in nodes]
    counts = []
    for piece in sorted(tally):
        c, i = divmod(piece >> 2 * _BITS, most)
        marks = sorted(by_cell.get(c, []))
        top = marks[i] if i < len(marks) else -(2**63) + (c + 1) * width  # the piece's end: a node, or the cell's border
        counts.append((piece, bisect.bisect_left(points, top) % len(points), tally[piece]))
    placed = walk(counts, nodes, quotas(sum(tally.values()), shards))
    lists: dict[int, list[tuple[int, int, int, int]]] = {}
    for piece, lo, hi, shard, slot in placed:
        lists.setdefault(piece, []).append((lo, hi, shard, slot))
    table = spark.createDataFrame(list(lists.items()), "p_piece long, runs array<struct<lo:long,hi:long,shard:int,slot:long>>")
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("point", "doc_id", "text_crc32", "size")) - 1
    ranked = located.withColumn("rank", rank).join(F.broadcast(table), F.col("piece") == F.col("p_piece"))
    mine = F.element_at(F.filter("runs", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), 1)
    return ranked.withColumn("run", mine).select("doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.lo")).cast("long").alias("slot"))


def op4_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
