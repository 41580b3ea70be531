"""Substring dedup: words covered by a window of WINDOW words that also starts anywhere else are removed.

Texts are recompressed in ROUNDS rounds (see recompress): equal passages have equal symbols inside. A window is stood for by a
symbol of the highest round that has one known by the window's words alone, so two equal windows choose the same symbol at the
same place. A symbol that stands once in the corpus proves all the windows it stands for unique, and those are most; symbols
that are shared reveal the repeats, which the windows' own hashes verify.

1. One scan names symbols and writes (symbol in its context, text, range of windows), about one row for every ten words.
2. An aggregation by symbol finds those that stand twice or more; a bit filter and a join keep their rows.
3. The windows of those rows are hashed from the texts, and compared within each symbol. What is compared is a 64-bit hash of the
   whole window under a 64-bit name of its part. Symbols of more than HOT rows are compared by an aggregation that combines
   before it shuffles, the others by a sorted pass of a task.
4. Ranges of repeated windows go back to their texts, which drop the words they cover.

Texts are shuffled only if they have a row in step 3 or 4: a bit filter of bounded size picks them from the scan. Copies of a
whole text are one text with a count; every window of a text that occurs twice is repeated.

Windows without a symbol of their own (inside long runs) stand for themselves. Defined results: a null or blank text has no words
and the checksum of the empty text; repeated rows are copies; very long texts are handled whole; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitfilter
from . import kernels as K
from .recompress import anchors, contexts, levels
from .shared import documents, lean, stash

WINDOW = 35
ROUNDS = 4
#: Rows of one symbol that a single task may compare.
HOT = 20_000


def _anchor_rows(width: int, rounds: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitfilter.passes(table.value, batch.column(1).to_numpy())))
            if not batch.num_rows:
                continue
            for base, buf, offs in K.text_chunks(batch.column(2)):
                w = K.Words(buf, offs)
                h = w.hashes()
                start, x = K.windows(h, w.first, width)
                if not len(start):
                    continue
                row = w.row[start]
                level, best = np.full(len(start), -1), np.full(len(start), -1)
                stands: list[tuple[np.ndarray, ...]] = []
                for s in levels(h, w.row, rounds):
                    of = anchors(s, w.first, width)[start]
                    some = of >= 0
                    level[some], best[some] = len(stands), of[some]
                    stands.append((s.name, s.c0, s.c1))
                own = best < 0
                cut = np.ones(len(start), bool)
                cut[1:] = (best[1:] != best[:-1]) | (level[1:] != level[:-1]) | (own[1:] & (x[1:] != x[:-1])) | (row[1:] != row[:-1])
                second = own[1:] & ~cut[1:] & cut[:-1]  # equal windows in a run: one row for the first, one for the rest
                cut[1:] |= second
                head = np.flatnonzero(cut)
                last = np.append(head[1:], len(start)) - 1
                place = start - w.first[row]
                name = x[head]
                c0, c1 = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
                for i, (names, first, end) in enumerate(stands):
                    at = np.flatnonzero(level[head] == i)
                    chosen = best[head[at]]
                    name[at], c0[at], c1[at] = names[chosen], first[chosen], end[chosen]
                at = np.flatnonzero(level[head] >= 0)
                name[at] = K.mix(name[at] ^ contexts(h, c0[at], c1[at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), batch.column(0).take(pa.array(row[head] + base)), pa.array(place[head].astype(np.int32)), pa.array(place[last].astype(np.int32))], names=["key", "handle", "lo", "hi"]
                )

    return run


_WINDOWS = "key long, m binary, lo int, hot boolean, hashes array<long>"


def _hash_ranges(width: int):
    """From texts with ranges of windows, the hashes of those windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            cuts = lists.offsets.to_numpy()
            key, lo, hi, hot = (lists.values.field(f) for f in range(4))
            lo_, hi_ = lo.to_numpy(), hi.to_numpy()
            for base, buf, offs in K.text_chunks(batch.column(1)):
                w = K.Words(buf, offs)
                start, x = K.windows(w.hashes(), w.first, width)
                first = np.searchsorted(start, w.first)
                n = w.n_rows
                at = np.arange(cuts[base], cuts[base + n])
                row = np.repeat(np.arange(n), np.diff(cuts[base : base + n + 1]))
                fits = hi_[at] < np.diff(first)[row]  # a range that came by a like handle may not
                at, row = at[fits], row[fits]
                sizes = (hi_[at] - lo_[at] + 1).astype(np.int64)
                ends = np.cumsum(sizes)
                take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[row] + lo_[at] - (ends - sizes), sizes)
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(at)), batch.column(0).take(pa.array(row + base)), lo.take(pa.array(at)), hot.take(pa.array(at)), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(x[take].view(np.int64)))],
                    names=["key", "m", "lo", "hot", "hashes"],
                )

    return run


_RANGE = "m binary, lo int, hi int"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that stand twice or more under their symbol. Rows come sorted by symbol; a symbol has HOT rows at most."""
    tail: pa.Table | None = None

    def judge(table: pa.Table) -> pa.RecordBatch:
        key = table.column("key").to_numpy()
        lists = table.column("hashes").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        cuts = lists.offsets.to_numpy()
        x = lists.values.to_numpy()[cuts[0] : cuts[-1]]
        sizes = np.diff(cuts)
        row = np.repeat(np.arange(len(key)), sizes)
        k = key[row]
        order = np.lexsort((x, k))
        same = (x[order[1:]] == x[order[:-1]]) & (k[order[1:]] == k[order[:-1]])
        twice = np.zeros(len(x), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        place = np.arange(len(x)) - np.repeat(cuts[:-1] - cuts[0], sizes) + table.column("lo").to_numpy()[row]
        at = np.flatnonzero(twice)
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
        head = np.flatnonzero(cut)
        last = np.append(head[1:], len(at)) - 1 if len(head) else head
        m = table.column("m").take(pa.array(row[at[head]])).combine_chunks()
        m = (m.chunk(0) if m.num_chunks else pa.array([], pa.binary())) if isinstance(m, pa.ChunkedArray) else m
        return pa.RecordBatch.from_arrays([m, pa.array(place[at[head]].astype(np.int32)), pa.array(place[at[last]].astype(np.int32))], names=["m", "lo", "hi"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([tail, table]) if tail is not None else table
        key = table.column("key").to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1])
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield judge(table.slice(0, cut))
        tail = table.slice(cut)
    if tail is not None:
        yield judge(tail)


_KEPT = "m binary, n_removed long, kept string"


def _words(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text, a few texts at a time."""
    for _, buf, offs in K.text_chunks(column):
        raw = buf.tobytes()
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            yield raw[a:b].split()


def _joined(words: list[bytes], digest: bool) -> str:
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


#: Rows of texts that a task hands on at once.
_ROWS = 500


def _remove(width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                n_removed, kept = [], []
                lists = batch.column(2)
                cuts = lists.offsets.to_numpy()
                lo, hi = (lists.values.field(f).to_numpy() for f in (0, 1))
                for i, words in enumerate(_words(batch.column(1))):
                    depth = np.zeros(len(words) + 1, np.int64)
                    at = slice(cuts[i], cuts[i + 1])
                    np.add.at(depth, lo[at], 1)
                    np.add.at(depth, np.minimum(hi[at] + width, len(words)), -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    kept.append(_joined([w for w, g in zip(words, gone.tolist(), strict=True) if not g], digest))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["m", "n_removed", "kept"])

    return run


def _plain(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                n_words, kept = [], []
                for words in _words(batch.column(2)):
                    n_words.append(len(words))
                    kept.append(_joined(words, digest))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "m", "n_words", "plain"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("m", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _filter(wanted: DataFrame):
    return wanted.sparkSession.sparkContext.broadcast(bitfilter.build(wanted.select(F.xxhash64("doc_id", "m").alias("h")), bitfilter.bits_for(wanted.count())))


def _fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(m, text) of the wanted texts (m, doc_id)."""
    bits = _filter(wanted)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1, 3]).filter(pa.array(bitfilter.passes(bits.value, batch.column(2).to_numpy())))

    found = rows.select("doc_id", "m", F.xxhash64("doc_id", "m").alias("h"), "text").mapInArrow(lean(sift), "doc_id long, m binary, text string")
    w = wanted.select(F.col("m").alias("w_m"), F.col("doc_id").alias("w_id"))
    return found.join(w, (found["m"] == w["w_m"]) & found["doc_id"].eqNullSafe(w["w_id"])).select("m", "text").dropDuplicates(["m"])


def repeated_ranges(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their text's key m; texts: m, first doc_id, copies; ranges of repeated windows: m, lo, hi)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs)
    texts = stash(rows.groupBy("m").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "texts")
    scan = rows.select(F.xxhash64("m").alias("handle"), F.xxhash64("doc_id", "m").alias("h"), "text")
    found = stash(scan.mapInArrow(lean(_anchor_rows(width, rounds, _filter(texts))), "key long, handle long, lo int, hi int"), "symbols")
    shared = stash(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", (F.col("c") > HOT).alias("hot")), "keys")
    bits = rows.sparkSession.sparkContext.broadcast(bitfilter.build(shared.select(F.col("key").alias("h")), bitfilter.bits_for(shared.count())))
    likely = found.mapInArrow(lean(lambda batches: (b.filter(pa.array(bitfilter.passes(bits.value, b.column(0).to_numpy()))) for b in batches)), found.schema)
    ranges = stash(likely.join(shared, "key").groupBy("handle").agg(F.collect_list(F.struct("key", "lo", "hi", "hot")).alias("ranges")), "shared")
    wanted = texts.withColumn("handle", F.xxhash64("m")).join(ranges.select("handle"), "handle").select("m", "doc_id")
    hashed = stash(_fetch(rows, wanted).withColumn("handle", F.xxhash64("m")).join(ranges, "handle").select("m", "text", "ranges").mapInArrow(lean(_hash_ranges(width)), _WINDOWS), "windows")
    cold = hashed.filter("not hot").select("key", "m", "lo", "hashes").repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(_repeated), _RANGE)
    each = hashed.filter("hot").select("key", "m", "lo", F.posexplode("hashes").alias("d", "x")).select("key", "x", "m", (F.col("lo") + F.col("d")).alias("lo"))
    twice = each.groupBy("key", "x").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "x")
    hot = each.join(twice, ["key", "x"]).select("m", "lo", F.col("lo").alias("hi"))
    return rows, texts, cold.unionByName(hot)


def dedup(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row of docs. kept: the words left, joined by one space; digest: their SHA-256 instead.

    With the digest no text is shuffled for the result.
    """
    rows, texts, ranges = repeated_ranges(docs, width, rounds)
    by_text = stash(ranges.groupBy("m").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "repeats")
    single = by_text.join(texts.filter("copies = 1"), "m").select("m", "doc_id", "ranges")
    changed = _fetch(rows, single.select("m", "doc_id")).join(single.select("m", "ranges"), "m").select("m", "text", "ranges").mapInArrow(lean(_remove(width, digest)), _KEPT)
    plain = rows.select("doc_id", "m", "text").mapInArrow(lean(_plain(digest)), "doc_id long, m binary, n_words long, plain string")
    copied = texts.filter("copies > 1").select("m", F.lit(True).alias("copied"))
    out = plain.join(copied, "m", "left").join(changed, "m", "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= width)
    nothing = hashlib.sha256(b"").hexdigest() if digest else ""
    return out.select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept", "plain")).alias("kept"),
    )


#: DuckDB's own way to op10: every window as text, counted.
ORACLE_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
wins AS (SELECT rid, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
twice AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
starts AS (SELECT rid, i FROM wins WHERE h IN (SELECT h FROM twice)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM starts),
lists AS (SELECT rid, list(k) AS ks FROM gone GROUP BY rid),
kept AS (SELECT a.rid, string_agg(a.x, ' ' ORDER BY a.k) AS t FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM words) a LEFT JOIN gone g ON g.rid = a.rid AND g.k = a.k WHERE g.k IS NULL GROUP BY a.rid)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(l.ks), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words w LEFT JOIN lists l USING (rid) LEFT JOIN kept k USING (rid)
"""


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")
