"""Suffix-array dedup: bytes covered by a window of WINDOW bytes that also starts earlier are removed.

Suffixes of all texts are sorted in shards (see induction), and in a sorted shard equal windows stand side by side with a common prefix of
WINDOW. What keeps shards small is that only passages with a partner are sorted:

1. Each window is stood for by an anchor, the GRAM bytes of least hash inside it, so equal windows have equal anchors at equal
   places. Consecutive windows with one anchor are a piece: about one row for every 35 bytes.
2. Aggregations by anchor, and by anchor and piece, combine before they shuffle. An anchor that stands once proves its windows unique. All
   pieces that are equal to an earlier one are repeats as a whole, and only the first goes on; so a passage that a third of all documents
   share is a few rows.
3. Anchors with several different pieces send these pieces' bytes to a shard by the anchor's hash. The shard's suffixes are sorted by
   induction, with common prefixes; of each group of equal windows the earliest stays. A shard's queues and arrays go to disk beyond
   a bound. Anchors with more than HOT pieces are compared by an aggregation over their windows' hashes instead.
4. Ranges of repeated windows go back to their texts, which drop the bytes they cover.

Copies of a whole text are one text with its least doc_id; the others are repeats as a whole. Texts are shuffled only if they lose bytes: a
bit filter of bounded size picks them from the scan. Pieces and the windows of HOT anchors are equal if 128 bits of hash are (64 of the anchor, 64 of the rest).

Defined results: a null text is empty; a text shorter than a window stays; rows with equal doc_id are one document, so of equal windows
at one place of them none is earlier; a null doc_id comes after all others; very long texts are read whole, a megabyte at a time; an empty
table gives an empty table; extra columns are ignored. Removing bytes may cut characters, so what is kept is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitfilter, induction
from . import kernels as K
from .shared import documents, lean, stash

WINDOW, GRAM = 100, 32
#: Bytes of a shard, as a mean.
SHARD = 2 << 20
#: Different pieces of one anchor that a shard may hold.
HOT = 20_000
#: Bytes of texts that are scanned at once.
PART = 1 << 19

_PLACE = 22
_VALUE = np.random.default_rng(20260111).integers(1, 2**63, 256, dtype=np.uint64)
_U = np.uint64


def _least_of(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by least values from block borders forth and back."""
    n = len(values)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, w)
    forth, back = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], forth[w - 1 : n])


class Pieces:
    """Pieces of a run of texts: row, first and last window (bytes from the buffer's start), anchor, hash, and whether they only repeat the window before."""

    __slots__ = ("anchor", "hi", "lo", "name", "rest", "row")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, width: int, gram: int):
        n = len(buf)
        none = np.zeros(0, np.int64)
        self.row = self.lo = self.hi = none
        self.anchor = self.name = none.astype(np.uint64)
        self.rest = none.astype(bool)
        if n < width:
            return
        power, inverse = K.powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[buf] * power[:n], out=total[1:])
        h = K.mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
        least = _least_of(h >> _U(_PLACE) << _U(_PLACE) | np.arange(len(h), dtype=np.uint64), width - gram + 1)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: n - width + 1]
        start = np.flatnonzero(np.arange(n - width + 1) + width <= offs[row + 1])
        if not len(start):
            return
        row, at = row[start], (least[start] & _U((1 << _PLACE) - 1)).astype(np.int64)
        cut = np.ones(len(start), bool)
        cut[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(cut)
        last = np.append(head[1:], len(start)) - 1
        lo, hi, at, row = start[head], start[last], at[head], row[head]
        anchor = h[at]
        name = K.mix((total[hi + width] - total[lo]) * inverse[lo] ^ K.mix((hi - lo).astype(np.uint64) << _U(32) | (at - lo).astype(np.uint64)) ^ anchor)
        again = np.zeros(len(lo), bool)  # a window equal to the one before it, as in runs
        again[1:] = (name[1:] == name[:-1]) & (anchor[1:] == anchor[:-1]) & (lo == hi)[1:] & (lo == hi)[:-1] & (lo[1:] == hi[:-1] + 1) & (row[1:] == row[:-1])
        keep = ~again
        keep[1:] |= again[1:] & ~again[:-1]  # one row for the rest of a run
        first = np.flatnonzero(keep)
        self.lo, self.hi = lo[first], hi[np.append(first[1:], len(lo)) - 1]
        self.row, self.anchor, self.name, self.rest = row[first], anchor[first], name[first], again[first]


def _parts(column: pa.Array, width: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes of it before, bytes, offsets): runs of whole texts, or overlapping parts of a long one that have all of its windows."""
    for base, buf, offs in K.text_chunks(column, size):
        if len(offs) > 2 or len(buf) <= 2 * size:
            yield base, 0, buf, offs
            continue
        for a in range(0, len(buf) - width + 1, size):
            part = buf[a : a + size + width - 1]
            yield base, a, part, np.array([0, len(part)])


def _piece_rows(width: int, gram: int, size: int, table):
    """Columns in: order, m, h, text. One row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitfilter.passes(table.value, batch.column(2).to_numpy())))
            for base, before, buf, offs in _parts(batch.column(3), width, size) if batch.num_rows else ():
                p = Pieces(buf, offs, width, gram)
                at = pa.array(p.row + base)
                lo = p.lo - offs[p.row] + before
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.anchor.view(np.int64)), pa.array(p.name.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(lo), pa.array((p.hi - p.lo).astype(np.int32)), pa.array(p.rest)],
                    names=["anchor", "name", "order", "m", "lo", "more", "rest"],
                )

    return run


_PIECE = "anchor long, name long, order long, m binary, lo long, more int, rest boolean"
_BYTES = "anchor long, hot boolean, order long, m binary, lo long, piece binary"


def _place_hash(name, order, lo):
    """What a filter of pieces at their places holds: the same in numpy and as columns."""
    return name ^ order ^ (lo << 7) if isinstance(name, np.ndarray) else name.bitwiseXOR(order).bitwiseXOR(F.shiftleft(lo, 7))


def _piece_bytes(width: int, gram: int, size: int, table, anchors, wanted, hot):
    """Columns in: order, m, h, text. The bytes of the wanted pieces; others that the filters let through do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitfilter.passes(table.value, batch.column(2).to_numpy())))
            orders = batch.column(0).to_numpy()
            for base, before, buf, offs in _parts(batch.column(3), width, size) if batch.num_rows else ():
                p = Pieces(buf, offs, width, gram)
                lo = p.lo - offs[p.row] + before
                some = np.flatnonzero(bitfilter.passes(anchors.value, p.anchor.view(np.int64)) & bitfilter.passes(wanted.value, _place_hash(p.name.view(np.int64), orders[p.row + base], lo)) & ~p.rest)
                if not len(some):
                    continue
                start, end = p.lo[some], p.hi[some] + width
                cuts = np.concatenate([[0], np.cumsum(end - start)])
                flat = buf[np.repeat(start - cuts[:-1], end - start) + np.arange(cuts[-1])]
                anchor = p.anchor[some].view(np.int64)
                at = pa.array(p.row[some] + base)
                raw = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(bitfilter.passes(hot.value, anchor)), batch.column(0).take(at), batch.column(1).take(at), pa.array(lo[some]), raw], names=["anchor", "hot", "order", "m", "lo", "piece"])

    return run


#: A filter may let a later copy of a text through: order tells which row a range is of.
_RANGE = "m binary, order long, lo long, hi long"


class _Shard:
    """Pieces of a partition, gathered as symbols: a byte's value plus 1, and 0 after each piece."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)
        self.size += sum(x.nbytes for x in batch.columns[4:5]) + batch.num_rows

    def symbols(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The text with room behind, and where each piece begins and the last ends."""
        sizes = np.concatenate([np.diff(np.frombuffer(b.column(4).buffers()[1], np.int32)[b.column(4).offset : b.column(4).offset + b.num_rows + 1]) for b in self.parts]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = induction.room(int(begin[-1]) + width + induction.WORD, np.uint16)
        done = 0
        for b in self.parts:
            column, n = b.column(4), b.num_rows
            offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
            raw = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
            to = np.arange(len(raw)) + np.repeat(begin[done : done + n] - (offs[:-1] - offs[0]), np.diff(offs))
            text[to] = raw
            text[to] += 1
            done += n
        return text, begin


def _later(order: np.ndarray, lo: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which entries are later than the earliest of their group."""
    by = np.lexsort((lo, order, group))
    g = group[by]
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    first = by[np.repeat(head, np.diff(np.append(head, len(by))))]
    out = np.empty(len(by), bool)
    out[by] = (order[by] > order[first]) | ((order[by] == order[first]) & (lo[by] > lo[first]))
    return out


def _sorted_shard(width: int, held: int):
    """Columns in: anchor, order, m, lo, piece, all of a shard. Ranges of windows that start later than an equal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            if batch.num_rows:
                shard.add(batch)
        if not shard.parts:
            return
        text, begin = shard.symbols(width)
        n = int(begin[-1])
        order, lo = (np.concatenate([b.column(c).to_numpy() for b in shard.parts]) for c in (1, 3))
        m = pa.chunked_array([b.column(2) for b in shard.parts])
        gone = induction.room(n, bool)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []  # of the group that the next block may go on with
        group = 0

        def judge(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
            at, g = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            piece = np.searchsorted(begin, at, "right") - 1
            window = at + width < begin[piece + 1]
            at, g, piece = at[window], g[window], piece[window]
            many = np.flatnonzero(np.bincount(g - g[0])[g - g[0]] > 1) if len(g) else np.zeros(0, np.int64)
            at, g, piece = at[many], g[many], piece[many]
            if len(at):
                gone[at[_later(order[piece], lo[piece] + at - begin[piece], g)]] = True

        for at, common in induction.suffixes(text, n, 257, width, held):
            groups = group + np.cumsum(common < width)
            open_ = int(np.searchsorted(groups, groups[-1]))
            if open_ or groups[0] != group:
                judge([*waiting, (at[:open_], groups[:open_])])
                waiting = []
            waiting.append((at[open_:].copy(), groups[open_:]))
            group = int(groups[-1])
        judge(waiting)
        at = np.flatnonzero(gone)
        piece = np.searchsorted(begin, at, "right") - 1
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
        head = np.flatnonzero(cut)
        last = np.append(head[1:], len(at)) - 1 if len(head) else head
        for i in range(0, len(head), 10_000):
            a, b = at[head[i : i + 10_000]], at[last[i : i + 10_000]]
            p = piece[head[i : i + 10_000]]
            yield pa.RecordBatch.from_arrays([m.take(pa.array(p)).combine_chunks(), pa.array(order[p]), pa.array(lo[p] + a - begin[p]), pa.array(lo[p] + b - begin[p])], names=["m", "order", "lo", "hi"])

    return run


def _window_hashes(width: int):
    """Columns in: anchor, order, m, lo, piece. Each window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, buf, offs in K.text_chunks(batch.column(4)):
                row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                start = np.flatnonzero(np.arange(len(buf)) + width <= offs[row + 1])
                at = pa.array(row[start] + base)
                x = K.span_hashes(buf, start, start + width)
                lo = batch.column(3).take(at).to_numpy() + start - offs[row[start]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(x.view(np.int64)), batch.column(1).take(at), batch.column(2).take(at), pa.array(lo)], names=["anchor", "x", "order", "m", "lo"])

    return run


_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, order (what doc_ids are compared by) and m (what texts are equal by)."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc.alias("doc_id"), text.alias("text")).withColumns({"order": F.coalesce("doc_id", F.lit(_LAST)), "m": F.unhex(F.md5(F.coalesce("text", F.lit(""))))})


def _broadcast(hashes: DataFrame):
    return hashes.sparkSession.sparkContext.broadcast(bitfilter.build(hashes.toDF("h"), bitfilter.bits_for(hashes.count())))


def _through(rows: DataFrame, table, column: int) -> DataFrame:
    return rows.mapInArrow(lean(lambda batches: (b.filter(pa.array(bitfilter.passes(table.value, b.column(column).to_numpy()))) for b in batches)), rows.schema)


def repeated_ranges(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, part: int = PART, held: int = induction.HELD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with order and m; texts: m, least order, copies; ranges of windows with an earlier equal one: m, order, lo, hi)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs)
    texts = stash(rows.groupBy("m").agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("copies")), "texts")
    least = _broadcast(texts.select(F.xxhash64("order", "m")))
    scan = rows.select("order", "m", F.xxhash64("order", "m").alias("h"), "text")
    found = stash(scan.mapInArrow(lean(_piece_rows(width, gram, part, least)), _PIECE), "pieces")
    runs = found.filter("rest").select("m", "order", "lo", (F.col("lo") + F.col("more")).alias("hi"))
    shared = stash(found.filter("not rest").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"), "anchors")
    likely = _through(found.filter("not rest"), _broadcast(shared), 0)
    first = F.min(F.struct("order", "lo")).alias("first")
    pieces = stash(likely.groupBy("anchor", "name").agg(first, F.count(F.lit(1)).alias("c"), F.max("more").alias("more")), "first")
    copies = pieces.filter("c > 1").select(F.col("anchor").alias("of"), F.col("name").alias("like"), "first")
    later = (F.col("anchor") == F.col("of")) & (F.col("name") == F.col("like"))
    whole = likely.join(copies, later).filter(F.struct("order", "lo") > F.col("first")).select("m", "order", "lo", (F.col("lo") + F.col("more")).alias("hi"))
    several = stash(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).filter("d > 1"), "several")
    hot = _broadcast(several.filter(F.col("d") > HOT).select("anchor"))
    anchors = _broadcast(several.select("anchor"))
    compared = stash(_through(pieces.select("anchor", "name", "first", "more"), anchors, 0), "compared")
    wanted = _broadcast(compared.select(_place_hash(F.col("name"), F.col("first.order"), F.col("first.lo"))))
    sent = stash(scan.mapInArrow(lean(_piece_bytes(width, gram, part, least, anchors, wanted, hot)), _BYTES), "bytes")
    size = compared.agg(F.coalesce(F.sum(F.col("more") + width + 2), F.lit(0)).alias("b")).first()["b"]
    shards = max(n, -(-size // SHARD))
    cold = sent.filter("not hot").drop("hot").repartition(shards, "anchor").mapInArrow(lean(_sorted_shard(width, held)), _RANGE)
    each = sent.filter("hot").drop("hot").mapInArrow(lean(_window_hashes(width)), "anchor long, x long, order long, m binary, lo long")
    earliest = each.groupBy("anchor", "x").agg(first).select(F.col("anchor").alias("of"), F.col("x").alias("like"), "first")
    heated = each.join(earliest, (F.col("anchor") == F.col("of")) & (F.col("x") == F.col("like"))).filter(F.struct("order", "lo") > F.col("first")).select("m", "order", "lo", F.col("lo").alias("hi"))
    return rows, texts, runs.unionByName(whole).unionByName(cold).unionByName(heated)


#: Rows that a task hands on at once, and bytes of what they keep.
_ROWS, _OUT = 500, 4 << 20


def _handed(names: list[str], types: list[pa.DataType], rows: Iterator[tuple], last: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
    for r in rows:
        held.append(r)
        size += len(r[last])
        if len(held) >= _ROWS or size >= _OUT:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def _kept(raw: bytes, digest: bool) -> bytes:
    return hashlib.sha256(raw).digest() if digest else raw


def _remove(width: int, digest: bool):
    """Columns in: m, text, ranges."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        lists = batch.column(2)
        cuts = lists.offsets.to_numpy()
        lo, hi = (lists.values.field(f).to_numpy() for f in (0, 1))
        for base, buf, offs in K.text_chunks(batch.column(1)):
            for i in range(len(offs) - 1):
                text = buf[offs[i] : offs[i + 1]]
                at = slice(cuts[base + i], cuts[base + i + 1])
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, lo[at], 1)
                np.add.at(depth, hi[at] + width, -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                yield batch.column(0)[base + i].as_py(), int(gone.sum()), spans, _kept(text[~gone].tobytes(), digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _handed(["m", "n_removed", "n_spans", "kept"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()], rows(batch), 3)

    return run


def _plain(digest: bool):
    """Columns in: doc_id, order, m, text."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, orders, m = (batch.column(c) for c in range(3))
        for base, buf, offs in K.text_chunks(batch.column(3)):
            for i in range(len(offs) - 1):
                raw = buf[offs[i] : offs[i + 1]].tobytes()
                yield ids[base + i].as_py(), orders[base + i].as_py(), m[base + i].as_py(), len(raw), _kept(raw, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _handed(["doc_id", "order", "m", "n_bytes", "plain"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()], rows(batch), 4)

    return run


def dedup(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, digest: bool = False, part: int = PART, held: int = induction.HELD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes left, of every row. digest: their SHA-256 instead; then no
    text that stays whole is shuffled. part: bytes of a long text scanned at once; held: bytes of a shard's queues kept in memory."""
    if not 0 < gram <= width < 255:
        raise ValueError("windows are of 1 to 254 bytes, and no shorter than a gram")
    rows, texts, ranges = repeated_ranges(docs, width, gram, part, held)
    # a list is no longer than its own text
    by_text = stash(ranges.groupBy("m", "order").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")).join(texts.select("m", "order"), ["m", "order"]), "repeats")
    wanted = _broadcast(by_text.select(F.xxhash64("order", "m")))
    texts_in = _through(rows.select("order", "m", F.xxhash64("order", "m").alias("h"), "text"), wanted, 2).select(F.col("order").alias("o"), F.col("m").alias("like"), "text")
    losing = texts_in.join(by_text, (F.col("like") == F.col("m")) & (F.col("o") == F.col("order"))).select("m", "text", "ranges")
    changed = losing.mapInArrow(lean(_remove(width, digest)), "m binary, n_removed long, n_spans long, kept binary").dropDuplicates(["m"])
    plain = rows.select("doc_id", "order", "m", "text").mapInArrow(lean(_plain(digest)), "doc_id long, order long, m binary, n_bytes long, plain binary")
    copied = texts.filter("copies > 1").select("m", F.col("order").alias("least"))
    out = plain.join(copied, "m", "left").join(changed, "m", "left")
    gone = F.coalesce(F.col("order") > F.col("least"), F.lit(False)) & (F.col("n_bytes") >= width)
    nothing = F.unhex(F.lit(hashlib.sha256(b"").hexdigest())) if digest else F.lit(b"")
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept", "plain")).alias("kept"),
    )


#: DuckDB's own way to op11: every window of the bytes (in hexadecimal), and the first place of each.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS x FROM documents),
wins AS (SELECT rid, o, i, md5(substr(x, 2 * i - 1, 200)) AS h FROM (SELECT rid, o, x, unnest(range(1, len(x) // 2 - 98)) AS i FROM d)),
first AS (SELECT h, min(struct_pack(o := o, i := i)) AS f FROM wins GROUP BY h HAVING count(*) > 1),
later AS (SELECT rid, i FROM wins JOIN first USING (h) WHERE struct_pack(o := o, i := i) > f),
marked AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM later),
spans AS (SELECT rid, min(i) AS a, max(i) + 100 AS b FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS s FROM marked) GROUP BY rid, s),
gaps AS (SELECT rid, coalesce(lag(b) OVER w, 1) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY rid ORDER BY a) UNION ALL SELECT rid, max(b), NULL FROM spans GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(x, 2 * a - 1, 2 * (coalesce(b, len(x) // 2 + 1) - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (rid) GROUP BY rid),
sums AS (SELECT rid, sum(b - a)::BIGINT AS n, count(*) AS c FROM spans GROUP BY rid)
SELECT doc_id, len(x)::BIGINT // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)
"""


def op11_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir), digest=True)
    return out.withColumn("kept_sha256", F.lower(F.hex("kept"))).drop("kept")
