"""N-gram Jaccard join: an exact metric-space join over sets of word shingles.

Finite sets under the size of their symmetric difference, d(x, y) = |x ^ y|, are a metric space, and two sets have a Jaccard similarity
of t or more where d(x, y) <= c * (|x| + |y|), c = (1 - t) / (1 + t). Everything below is that metric.

* Pivots of the first level. Nearly all documents are about |x| + |y| from nearly all others, so a few documents as pivots tell nothing apart
  (the README has figures). The first pivots are therefore the smallest sets, single shingles: a document is nearer to {s} than to the
  empty set where it holds s, and it is replicated into the regions of the shingles that can be the first one, rarest first, that it
  shares with a partner. Shingles of one document alone need no region.
* Pivots of the second level are documents. Every region takes its member with the least share of shingles of its own, the same one in
  all regions that it leads; the distance of each member to its pivots is taken on the texts, and those within the threshold are linked.
* The regions of one pivot document, as far as their members are still in different components, are joined as one: in a task, where
  they hold up to BLOCK members. A larger region is joined recursively. It takes a pivot p, and each member moves to x ^ p, which keeps all
  distances; members near p have become small. By the triangle inequality two members that share nothing after the move are both
  within the threshold of p or not of each other, so after linking p each other pair shares one of the first places of the moved sets,
  and these are the regions of the next level, until all of them fit.

No level makes rows for pairs: regions hold members, and what leaves them are links that join two components. No link between different
texts can get lost, and no group of linked copies is expanded into pairs. Regions of up to SMALL members, which hold the most, are compared
at once by lower bounds from further pivots (sizes, places, 128 classes of shingles). Documents with equal sets are one point of the
space (they are joined once, and copies follow by their set's key).

Defined results: a null or blank text has an empty set, no partner, and is its own component; repeated rows and copies
share a component; component_id is the smallest non-null doc_id, null if all are null; very long texts are joined whole; ties among
pivots go by id and change no result; an empty table gives an empty table; extra columns are ignored (`classes`) or kept (`one_of_each`),
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitfilter
from . import kernels as K
from .graph import components
from .shared import documents, fresh, lean, stash
from .streams import runs

#: Shingles whose hash lies below a share of the range come first in the global order, and are counted for every document. The share is
#: this many times that of a set in which the first common shingle can stand.
ZONE = 1.3
#: Members and shingles of a document pivot's region that a task joins at once; larger ones are joined recursively.
BLOCK = 4000
WEIGHT = 2_000_000
#: A region of up to so many blocks, and one that its pivot has not halved, is joined block by block instead.
BLOCKS = 8
CLASSES = 128
#: Sets whose connections a verifying task remembers, to leave out links that join nothing new.
FOREST = 200_000
#: Pairs that a task looks at together, which bounds its memory.
PAIRS = 100_000
#: Regions up to this size compare their members at once by bounds.
SMALL = 8
#: Postings that a region's join counts at once.
STEP = 4_000_000


def zone_top(percent: int) -> np.uint64:
    """Where the zone ends."""
    return np.uint64(int(min(1.0, ZONE * (1 - percent / 100)) * (2**64 - 1)))


def prefix_length(n: int | np.ndarray, num: int) -> int | np.ndarray:
    """Places of the order in which the first common shingle with a partner at num/100 or more can stand."""
    return n - (-(-num * n // 100)) + 1


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased; of fewer words, one of the whole sequence."""
    for _, buf, offs in K.text_chunks(texts):
        w = K.Words(buf, offs)
        h = w.hashes(lower=True)
        start, x = K.windows(h, w.first, k)
        cut = np.searchsorted(start, w.first)
        for i in range(w.n_rows):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                s = np.sort(x[cut[i] : cut[i + 1]])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield np.array([int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


_POINT = "doc_id long, th long, n long, zone_n int, whole boolean, key binary, counted array<long>, hist binary"


def _describe(k: int, num: int):
    top = zone_top(num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, zone_n, whole, key, counted, hist = [], [], [], [], [], []
                for s in shingle_sets(part.column(2), k):
                    size, zone = len(s), int(np.searchsorted(s, top))
                    full = size > 0 and zone < prefix_length(size, num)
                    n.append(size)
                    zone_n.append(zone)
                    whole.append(full)
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if size else None)
                    counted.append((s if full else s[:zone]).view(np.int64))
                    hist.append(np.minimum(np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes())
                sizes = np.cumsum([0, *map(len, counted)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(counted) if counted else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(zone_n, pa.int32()), pa.array(whole, pa.bool_()), pa.array(key, pa.binary()), lists, pa.array(hist, pa.binary())],
                    names=["doc_id", "th", "n", "zone_n", "whole", "key", "counted", "hist"],
                )

    return run


_MEMBER = "s long, id long, n long, i long, own long"


def _regions_of(num: int):
    """From each set's shingles that other sets hold too, the regions that it belongs to, with the pivot's place in its order.

    own: the set's share of shingles of its own; the sets with the least are the hubs, the same ones in all regions.
    """
    top = zone_top(num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_s, out_i, out_own, out_row = [], [], [], []
            lists = batch.column(batch.schema.get_field_index("shared"))
            offs = lists.offsets.to_numpy()
            df, s = (lists.values.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
            n, zone_n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n", "zone_n"))
            for r in range(batch.num_rows):
                d, x = df[offs[r] : offs[r + 1]], s[offs[r] : offs[r + 1]].view(np.uint64)
                far = x >= top
                order = np.lexsort((x, d, far))
                d, x, far = d[order], x[order], far[order]
                near = int(np.count_nonzero(~far))
                place = np.arange(len(x)) + (zone_n[r] - near)
                place[near:] += n[r] - zone_n[r] - (len(x) - near)
                keep = place < prefix_length(int(n[r]), num)
                out_s.append(x[keep].view(np.int64))
                out_i.append(place[keep])
                out_own.append(np.full(int(keep.sum()), 1000 * (zone_n[r] - near) // n[r]))
                out_row.append(np.full(int(keep.sum()), r))
            if out_row:
                rows = pa.array(np.concatenate(out_row), pa.int64())
                col = lambda c: batch.column(batch.schema.get_field_index(c)).take(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_s), pa.int64()), col("id"), col("n"), pa.array(np.concatenate(out_i), pa.int64()), pa.array(np.concatenate(out_own), pa.int64())], names=["s", "id", "n", "i", "own"])

    return run


def _small_regions(num: int):
    """Pairs of regions of up to SMALL members that the bounds leave; rows come sorted by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([tail, table]) if tail is not None else table).combine_chunks()
            cut = int(_starts(table.column("s").to_numpy())[-1])  # the last region may go on in the next batch
            yield _pairs(table.slice(0, cut), num)
            tail = table.slice(cut)
        if tail is not None:
            yield _pairs(tail.combine_chunks(), num)

    return run


def _starts(s: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])


def _links_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["a", "b"])


def _pairs(table: pa.Table, num: int) -> pa.RecordBatch:
    if table.num_rows < 2:
        return _links_of([], [])
    n, i, ids = (table.column(c).to_numpy() for c in ("n", "i", "id"))
    hist = np.frombuffer(b"".join(table.column("hist").to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
    starts = _starts(table.column("s").to_numpy())
    sizes = np.diff(np.append(starts, table.num_rows))
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, SMALL + 1):
        base = starts[sizes == m]
        a, b = np.triu_indices(m, 1)
        step = max(1, PAIRS // len(a))
        for k in range(0, len(base), step):
            x, y = (base[k : k + step, None] + a).ravel(), (base[k : k + step, None] + b).ravel()
            need = -(-num * (n[x] + n[y]) // (100 + num))
            ok = np.flatnonzero((100 * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])) & (np.minimum(n[x] - i[x], n[y] - i[y]) >= need))
            for j in range(0, len(ok), 4096):
                q = ok[j : j + 4096]
                u, v = x[q], y[q]
                near = np.abs(hist[u] - hist[v]).sum(axis=1, dtype=np.int64) <= n[u] + n[v] - 2 * need[q]
                xs.append(u[near])
                ys.append(v[near])
    u, v = ids[np.concatenate(xs)], ids[np.concatenate(ys)]
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
    return _links_of(both[:, 0], both[:, 1])


def _verify(k: int, num: int):
    """Links that the texts confirm; those that join what the task has joined already are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, None
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for batch in batches:
            a, b = [], []
            sets = shingle_sets(batch.column(4), k)
            cells, salts, roles, others = (batch.column(c).to_pylist() for c in range(4))
            for cell, salt, role, other, s in zip(cells, salts, roles, others, sets, strict=True):
                if role == 0:
                    now, hub = (cell, salt), s
                elif now == (cell, salt):
                    at = np.searchsorted(hub, s)
                    both = int(np.count_nonzero(hub[np.minimum(at, len(hub) - 1)] == s))
                    if 100 * both >= num * (len(hub) + len(s) - both) and (u := find(cell)) != (v := find(other)):
                        root[max(u, v)] = min(u, v)
                        a.append(cell)
                        b.append(other)
            if len(root) > FOREST:
                root.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _spread(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _sifted(rows: DataFrame, wanted: DataFrame, schema: str) -> DataFrame:
    """rows (h, ...) that may have an h of wanted (h), without h: all that have, and few others while wanted fits a bit filter."""
    bits = rows.sparkSession.sparkContext.broadcast(bitfilter.build(wanted, bitfilter.bits_for(wanted.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(range(1, batch.num_columns)).filter(pa.array(bitfilter.passes(bits.value, batch.column(0).to_numpy())))

    return rows.mapInArrow(lean(run), schema)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted sets (id, doc_id, th)."""
    h = F.xxhash64("doc_id", "th").alias("h")
    rows = _sifted(docs.select(h, "doc_id", "th", "text"), wanted.select(h), "doc_id long, th long, text string")
    w = wanted.select("id", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"))
    found = rows.join(w, rows["doc_id"].eqNullSafe(w["w_id"]) & (rows["th"] == w["w_th"]))
    return found.select("id", "text").dropDuplicates(["id"])


def _linked(pairs: DataFrame, texts: DataFrame, k: int, num: int) -> DataFrame:
    """Those of the pairs (a, b) that the texts confirm, as far as they connect. A hub's partners are dealt over 16 tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
    heads = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    tails = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "text")
    return _spread(heads.unionByName(tails), "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(lean(_verify(k, num)), "a long, b long")


def _merge(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, label) after further links: only the components that these join are looked at again."""
    named = known.select("node", "label")
    ends = links.join(named.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(named.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct())
    fresh = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().join(named, "node", "left_anti")
    seen = named.union(fresh.select("node", F.col("node").alias("label")))
    return seen.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))


_PLACED = "region long, side int, id long, n long, comp long, items array<long>"


def _join_regions(num: int):
    """Links that join components of a region. Rows (see _PLACED) come sorted by region; a region fits a task.

    Overlaps are counted over the postings of shared items, for each member outside the region's largest component.
    """

    def join(ids: np.ndarray, side: np.ndarray, n: np.ndarray, comp: np.ndarray, lens: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int]]:
        m, two = len(ids), side.min() < side.max()
        _, label, count = np.unique(comp, return_inverse=True, return_counts=True)
        if len(count) < 2:
            return
        size = count.copy()
        row = np.repeat(np.arange(m), lens)
        order = np.argsort(items, kind="stable")
        sorted_items, posting = items[order], row[order]
        head = np.flatnonzero(np.concatenate([[True], sorted_items[1:] != sorted_items[:-1]]))
        width = np.diff(np.append(head, len(items)))
        which = np.empty(len(items), np.int64)
        which[order] = np.repeat(np.arange(len(head)), width)
        first = np.concatenate([[0], np.cumsum(lens)])
        for x in np.flatnonzero(label != np.argmax(size)).tolist():
            mine = which[first[x] : first[x + 1]]
            mine = mine[width[mine] > 1]
            over = np.zeros(m, np.int64)
            cuts = np.cumsum(width[mine])
            at = 0
            while at < len(mine):
                to = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + STEP, "right")))
                part = mine[at:to]
                w = width[part]
                over += np.bincount(posting[np.repeat(head[part] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))], minlength=m)
                at = to
            far = lens[x] + lens - 2 * over
            near = ((100 + num) * far <= (100 - num) * (n[x] + n)) & (over > 0) & (label != label[x])
            if two:
                near &= side != side[x]
            for y in np.flatnonzero(near).tolist():
                a, b = label[x], label[y]
                if a != b:
                    label[label == a] = b
                    yield int(ids[x]), int(ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            lists = table.column("items")
            ids, side, n, comp = (table.column(c).to_numpy() for c in ("id", "side", "n", "comp"))
            lens = pc.list_value_length(lists).to_numpy().astype(np.int64)
            items = pc.list_flatten(lists).to_numpy()
            links = list(join(ids, side, n, comp, lens, items))
            if links:
                yield _links_of([x for x, _ in links], [y for _, y in links])

    return run


_MOVED = "region long, id long, n long, comp long, near boolean, p_id long, p_n long, items array<long>"


def _move(num: int):
    """Members as x ^ p, and whether they are within the threshold of the region's pivot p; those take its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            n, comp, p_n, p_comp = (col(c).to_numpy() for c in ("n", "comp", "p_n", "p_comp"))
            mine, theirs = col("items"), col("p_items")
            moved = [np.setxor1d(mine[i].values.to_numpy(), theirs[i].values.to_numpy(), assume_unique=True) for i in range(batch.num_rows)]
            far = np.array([len(x) for x in moved], np.int64)
            near = (100 + num) * far <= (100 - num) * (n + p_n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(far)]).astype(np.int32)), pa.array(np.concatenate(moved) if moved else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([col("region"), col("id"), col("n"), pa.array(np.where(near, p_comp, comp)), pa.array(near), col("p_id"), col("p_n"), lists], names=["region", "id", "n", "comp", "near", "p_id", "p_n", "items"])

    return run


def _places(num: int):
    """Regions of the next level: of each moved set the items, rarest first, that can be the first one shared with a partner.

    Partners are in another component, so at most one of the two is near the pivot. That bounds what they share from below:
    by the triangle inequality half of d(x, p) - c * (|x| + |p|) for a member not near p, of d(x, p) + c * (|p| - |x|) for one near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(batch.schema.get_field_index("shared"))
            cuts = shared.offsets.to_numpy()
            df, e, mixed = (shared.values.field(f).to_numpy(zero_copy_only=False) for f in range(3))
            n, p_n, near, far = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "p_n", "near", "far"))
            bound = (100 + num) * far + np.where(near, (100 - num) * (p_n - n), -(100 - num) * (p_n + n))
            least = np.maximum(1, -(-bound // (2 * (100 + num))))
            out, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in range(batch.num_rows):
                d, x, some = df[cuts[r] : cuts[r + 1]], e[cuts[r] : cuts[r + 1]], mixed[cuts[r] : cuts[r + 1]]
                order = np.lexsort((x, d))
                keep = order[: max(0, int(far[r] - least[r] + 1 - (far[r] - len(x))))]
                keep = keep[some[keep]]
                out.append(x[keep])
                row.append(np.full(len(keep), r))
            rows = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(out))], names=["region", "id", "e"])

    return run


def _regions(placed: DataFrame, num: int) -> list[DataFrame]:
    """Links of the pairs within regions (region, was, id, n, comp, items), as far as they join components; large regions recursively.

    was: the members of the region that a region comes from.
    """
    found: list[DataFrame] = []
    while True:
        size = placed.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("items")).alias("w"), F.first("was").alias("was"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1")
        parts = F.ceil(F.greatest(2 * F.col("m") / BLOCK, 2 * F.col("w") / WEIGHT)).cast("int")
        fits = (F.col("m") <= SMALL) | (F.col("m") <= BLOCK) & (F.col("w") <= WEIGHT)
        deep = ~fits & (F.col("m") > BLOCK * BLOCKS) & (2 * F.col("m") <= F.col("was"))
        size = stash(size.select("region", "m", deep.alias("deep"), F.when(fits, 1).otherwise(F.least(parts, F.col("m").cast("int"))).alias("parts")), "region-sizes")
        now = placed.join(size.filter("not deep"), "region").withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # a block meets itself in its own cell, and each other block in a cell of the two
        now = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cell = F.when(F.col("parts") == 1, F.col("region")).otherwise(F.xxhash64("region", F.least("side", "other"), F.greatest("side", "other")))
        cells = _spread(now.select(cell.alias("region"), "side", "id", "n", "comp", "items"), "region").sortWithinPartitions("region")
        found.append(stash(cells.mapInArrow(lean(_join_regions(num)), "a long, b long"), "region-links"))
        large = size.filter("deep").select("region", "m")
        if large.isEmpty():
            return found
        left = stash(placed.join(large, "region"), "large-regions")
        at = left.groupBy("region").agg(F.min(F.struct(F.xxhash64("region", "id").alias("h"), "id")).alias("p")).select("region", F.col("p.id").alias("id"))
        pivots = left.join(at, ["region", "id"]).select("region", F.col("id").alias("p_id"), F.col("n").alias("p_n"), F.col("comp").alias("p_comp"), F.col("items").alias("p_items"))
        moved = stash(left.join(pivots, "region").mapInArrow(lean(_move(num)), _MOVED), "moved")
        found.append(moved.filter("near and id <> p_id").select(F.col("p_id").alias("a"), F.col("id").alias("b")))
        each = moved.filter("id <> p_id").select("region", "id", "comp", F.explode("items").alias("e"))
        shared = each.groupBy("region", "e").agg(F.count(F.lit(1)).alias("df"), (F.min("comp") < F.max("comp")).alias("mixed")).filter("df > 1")
        held = each.join(shared, ["region", "e"]).groupBy("region", "id").agg(F.collect_list(F.struct("df", "e", "mixed")).alias("shared"))
        about = moved.select("region", "id", "n", "p_n", "near", F.size("items").alias("far"))
        next_places = held.join(about, ["region", "id"]).mapInArrow(lean(_places(num)), "region long, id long, e long")
        next_level = next_places.join(moved, ["region", "id"]).join(large.withColumnRenamed("m", "was"), "region")
        placed = stash(next_level.select(F.xxhash64("region", "e").alias("region"), "was", "id", "n", "comp", "items"), "regions")


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = list(shingle_sets(part.column(1), k))
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "items"])

    return run


def _solve(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The points of all rows, and for each distinct set (key) its component's label, least doc_id, and first (doc_id, th)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    points = stash(rows.select("doc_id", "th", "text").mapInArrow(lean(_describe(k, percent)), _POINT).withColumn("rid", F.monotonically_increasing_id()), "points")
    full = points.filter("key is not null")
    # a set's id is its first row's, which stands for all rows with the set
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("p")
    ids = stash(full.groupBy("key").agg(F.min("rid").alias("id"), first_row, F.min("doc_id").alias("least_id")).select("key", "id", "least_id", F.col("p.doc_id").alias("doc_id"), F.col("p.th").alias("th")), "sets")
    about = full.join(ids.select("id"), F.col("rid") == F.col("id")).select("id", "n", "zone_n")
    classes_of = full.join(ids.select("id"), F.col("rid") == F.col("id")).select("id", "hist")
    h = F.xxhash64("rid").alias("h")
    shingles = _sifted(full.select(h, "rid", "counted"), ids.select(F.xxhash64("id").alias("h")), "rid long, counted array<long>").select("rid", F.explode("counted").alias("s"))
    shared = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = shingles.join(shared, "s").groupBy(F.col("rid").alias("id")).agg(F.collect_list(F.struct(F.col("df"), F.col("s"))).alias("shared"))
    members = stash(held.join(about, "id").mapInArrow(lean(_regions_of(percent)), _MEMBER), "members")
    pivot = F.min(F.struct("own", "id", "n", "i")).alias("p")
    sizes = members.groupBy("s").agg(F.count(F.lit(1)).alias("m"), pivot).filter("m > 1").select("s", "m", F.col("p.id").alias("p"), F.col("p.n").alias("p_n"), F.col("p.i").alias("p_i"))
    dealt = stash(members.join(sizes, "s").select("s", "m", "id", "n", "i", "p", "p_n", "p_i"), "regions")
    small = _spread(dealt.filter(F.col("m") <= SMALL).select("s", "id", "n", "i").join(classes_of, "id"), "s").sortWithinPartitions("s").mapInArrow(lean(_small_regions(percent)), "a long, b long")
    in_reach = (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")) & ((100 + percent) * F.least(F.col("n") - F.col("i"), F.col("p_n") - F.col("p_i")) >= percent * (F.col("n") + F.col("p_n")))
    large = dealt.filter(F.col("m") > SMALL)
    to_pivots = large.filter((F.col("id") != F.col("p")) & in_reach).select(F.col("p").alias("a"), F.col("id").alias("b"))
    first = stash(small.union(to_pivots).distinct(), "to-test")
    ends = first.select(F.col("a").alias("id")).union(first.select(F.col("b").alias("id"))).distinct()
    known = components(stash(_linked(first, stash(_fetch(rows, ids.join(ends, "id")), "texts"), k, percent), "links"))
    # regions of document pivots: the members of those shingles' regions that are not all in one component
    labels = known.select(F.col("node").alias("id"), F.col("label").alias("comp"))
    placed = large.select("s", "p", "id", "n").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = placed.groupBy("s").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("s")
    placed = stash(placed.join(mixed, "s", "left_semi").select(F.col("p").alias("region"), "id", "n", "comp").distinct(), "placed")
    if not placed.isEmpty():
        items = stash(_fetch(rows, ids.join(placed.select("id").distinct(), "id")).mapInArrow(lean(_items(k)), "id long, items array<long>"), "items")
        links = None
        for part in _regions(placed.join(items, "id").select("region", F.lit(2**62).alias("was"), "id", "n", "comp", "items"), percent):
            links = part if links is None else links.union(part)
        known = stash(_merge(known, links), "components")
    return points, ids.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (see module). Links: an intersection of `percent` of the union or more."""
    points, sets = _solve(docs, k, percent)
    least = sets.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_key = sets.join(least, "label").select("key", "component_id")
    return points.select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_key, "key", "left").select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id (nulls come last, ties go by the text's hash).

    Rows equal in doc_id and text are one document. Rows without a word are in no group and stay.
    """
    _, sets = _solve(docs, k, percent)
    h, th, h2, id2, th2 = (fresh(docs, name) for name in ("h", "th", "h2", "id2", "th2"))
    first = sets.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("p"))
    first = stash(first.select(F.xxhash64("p.doc_id", "p.th").alias(h2), F.col("p.doc_id").alias(id2), F.col("p.th").alias(th2)), "kept")
    key = F.xxhash64(F.col("text").cast("string"))
    hashed = docs.withColumns({th: key, h: F.xxhash64(F.col("doc_id").cast("long"), key)})
    words = F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    same = (F.col(h) == F.col(h2)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id2)) & (F.col(th) == F.col(th2))
    kept = hashed.filter(words).join(first, same, "left_semi").dropDuplicates([h, "doc_id", th])
    return kept.select(*docs.columns).unionByName(docs.filter(~words))


#: DuckDB's own way to op7: shingles as text, pairs counted by their shared shingles, links followed by recursion over distinct sets.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) END AS s FROM words),
points AS (SELECT s, min(rid) AS id, min(doc_id) AS least, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT id, n, unnest(s) AS e FROM points),
pairs AS (SELECT a.id AS x, b.id AS y FROM items a JOIN items b ON a.e = b.e AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT id AS x, id AS y FROM points UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT r.x AS id, min(p.least) AS component_id FROM reach r JOIN points p ON p.id = r.y GROUP BY r.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE l.component_id END AS component_id FROM sets s LEFT JOIN points p ON p.s = s.s LEFT JOIN least l ON l.id = p.id
"""


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir), k=4, percent=85)
