"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token ids. The stream of sequences is filled window by window; in each window the queues are served
in turn, each with its share of the window's tokens and the deficit it carries from the windows before. A queue's deficit
is what its exact share x * p of the first x tokens falls short of the tokens served. Serving always the queue whose next token has been due
longest keeps it about half a token, and gives the served amounts a closed form. That is what makes the rounds
distributable: where a document goes follows from the number of tokens before it in its queue alone, and deficits carry over
windows and partitions without a sequential pass. When a queue runs dry, a new phase shares its part among the rest.

Targets: those handed in, or sources weighted by tokens ** TEMPERATURE, rounded to powers of two (see `by_temperature`), so that small sources
are seen early and often. Sources of one size class run dry together, so there are as many phases as classes, whatever the number of sources.

Documents are encoded once and written to the shared folder with their place in the partition's queues; only sums by partition and
source are shuffled, and they are broadcast if they are few, else joined. Every source has its own queue, however many there
are: the driver sees one row for each, tasks hold one number for each and compute a window's border from all of them.

Defined results: a null or empty text is the end id alone; a null source is a queue of its own; repeated rows are packed each; ties
go by partition and queue; very long texts are cut over as many sequences as they need; an empty table gives no pieces; extra columns are ignored. Only the last sequence has padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder, tokenizer_path
from .shared import documents, lean, stash

SEQUENCE = 2048
#: Sequences in a window: within each, token proportions are the targets'.
WINDOW_SEQUENCES = 64
#: Queues up to which the table of their numbers is broadcast, and a task keeps all of Windows.KEPT borders.
QUEUES = 1024
END_ID = 1
#: Exponent of a source's tokens in its weight: 1 keeps the corpus' own proportions, 0 gives all size classes the same.
TEMPERATURE = 0.7
#: Rows of the (partition, source) table up to which it is broadcast (about 5 MB).
BROADCAST_ROWS = 50_000

_QUEUED = "pid int, doc_id long, source string, before long, n long, ids binary"


def _enqueue(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        served: dict[str | None, int] = {}
        enc, end = encoder(path), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [x + end for x in enc.encode(part.column(2).to_pylist())]
                before = []
                for source, x in zip(part.column(1).to_pylist(), ids, strict=True):
                    before.append(served.get(source, 0))
                    served[source] = before[-1] + len(x) // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), pid, np.int32)), part.column(0), part.column(1), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["pid", "doc_id", "source", "before", "n", "ids"],
                )

    return run


@dataclass(frozen=True)
class Phase:
    """A stretch of the stream with fixed shares: from token `at`, `length` tokens, of which queue k serves served[k] after base[k] earlier ones."""

    at: int
    length: int
    base: tuple[int, ...]
    served: tuple[int, ...]

    @cached_property
    def amounts(self) -> np.ndarray:
        return np.array(self.served, np.int64)

    def upto(self, x: int) -> np.ndarray:
        """How many of the phase's first x tokens each queue serves.

        Token j of a queue that serves m is due at (2j + 1) / 2m of the phase, and tokens go by their due times, then by queue. At any
        time a queue is at most half a token from its exact share, and what has been served never falls.
        """
        x = min(x, self.length)
        m = self.amounts
        due = (m * (x / self.length) + 0.5).astype(np.int64)  # all those due until then, but for rounding: (2mx + length) // 2length
        due += (m * np.int64(2 * x) + np.int64(self.length) - due * np.int64(2 * self.length)) // np.int64(2 * self.length)  # small, so exact even if terms wrap
        if (over := int(due.sum()) - x) > 0:
            last = [(-Fraction(2 * int(due[k]) - 1, 2 * self.served[k]), -k) for k in self._first(np.flatnonzero(due), 1 - 2 * due, over)]
            heapq.heapify(last)
            for _ in range(over):
                k = -heapq.heappop(last)[1]
                due[k] -= 1
                if due[k]:
                    heapq.heappush(last, (-Fraction(2 * int(due[k]) - 1, 2 * self.served[k]), -k))
        elif over < 0:
            next_ = [(Fraction(2 * int(due[k]) + 1, 2 * self.served[k]), k) for k in self._first(np.flatnonzero(due < m), 2 * due + 1, -over)]
            heapq.heapify(next_)
            for _ in range(-over):
                k = heapq.heappop(next_)[1]
                due[k] += 1
                if due[k] < self.served[k]:
                    heapq.heappush(next_, (Fraction(2 * int(due[k]) + 1, 2 * self.served[k]), k))
        return due

    def _first(self, queues: np.ndarray, times: np.ndarray, n: int) -> list[int]:
        """Of these queues, those among which the n of least times / 2m are, with all that rounding cannot tell from them."""
        if n < len(queues):
            key = times[queues] / (2 * self.amounts[queues])
            queues = queues[key <= np.partition(key, n - 1)[n - 1] + 1e-12]
        return queues.tolist()


def plan(totals: list[int], weights: list[float] | None = None) -> list[Phase]:
    """Phases that use up all queues. weights: target token proportions; by default those of the totals, for which one phase does."""
    left, base, at, phases = list(totals), [0] * len(totals), 0, []
    goal = list(totals) if weights is None else weights
    while any(left):
        active = [k for k, n in enumerate(left) if n]
        if not any(goal[k] > 0 for k in active):
            goal = [1.0] * len(left)
        rounds = min(left[k] / goal[k] for k in active if goal[k] > 0)
        take = [min(left[k], round(goal[k] * rounds)) if left[k] and goal[k] > 0 else 0 for k in range(len(left))]
        for k in active:
            if goal[k] > 0 and left[k] / goal[k] <= rounds:
                take[k] = left[k]
        phases.append(Phase(at, sum(take), tuple(base), tuple(take)))
        at += sum(take)
        left = [a - b for a, b in zip(left, take, strict=True)]
        base = [a + b for a, b in zip(base, take, strict=True)]
    return phases


def by_temperature(totals: list[int], temperature: float) -> list[Phase]:
    """Phases in which queue k has the weight totals[k] * f, f = 2 ** -((1 - temperature) * bits), bits being those of its total.

    Served at the time x are totals[k] * f * x tokens, all of them from x = 1 / f on, when the queue's whole class is done.
    """
    pace = [2.0 ** -((1 - temperature) * n.bit_length()) for n in totals]
    done, at, phases = [0] * len(totals), 0, []
    for x in sorted({1 / f for f, n in zip(pace, totals, strict=True) if n}):
        upto = [n if 1 / f <= x else min(n, int(n * f * x)) for n, f in zip(totals, pace, strict=True)]
        phases.append(Phase(at, sum(upto) - sum(done), tuple(done), tuple(b - a for a, b in zip(done, upto, strict=True))))
        at, done = sum(upto), upto
    return phases


class Windows:
    """The windows of a plan. What queues have served by a window's border is kept for the windows asked for last."""

    KEPT = 4096

    def __init__(self, phases: list[Phase], window: int):
        self.phases, self.window = phases, window
        queues = len(phases[0].served) if phases else 1
        self.kept = min(self.KEPT, max(8, self.KEPT * QUEUES // queues))
        self.borders: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def border(self, i: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens served before window w of phase i, by queue, and their sums over the queues before."""
        if (i, w) not in self.borders:
            if len(self.borders) >= self.kept:
                self.borders.clear()
            done = self.phases[i].upto(w * self.window)
            self.borders[i, w] = done, np.cumsum(done) - done
        return self.borders[i, w]

    def spans(self, queue: int, begin: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(start in the document, place in the stream, length) of the stretches that tokens begin..begin+n of a queue go to."""
        done = 0
        for i, p in enumerate(self.phases):
            served = p.served[queue]
            r = begin + done - p.base[queue]
            if not 0 <= r < served:
                continue
            w = (2 * r + 1) * p.length // (2 * served) // self.window
            while self.border(i, w)[0][queue] > r:
                w -= 1
            while done < n and r < served:
                while self.border(i, w + 1)[0][queue] <= r:
                    w += 1
                (first, below), (after, below_after) = self.border(i, w), self.border(i, w + 1)
                length = min(n - done, int(after[queue]) - r)
                yield done, p.at + w * self.window + int(below_after[queue] - below[queue] - first[queue]) + r, length
                done, r = done + length, r + length
            if done == n:
                return


def spans(phases: list[Phase], queue: int, begin: int, n: int, window: int) -> list[tuple[int, int, int]]:
    return list(Windows(phases, window).spans(queue, begin, n))


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _cut(phases: list[Phase], sequence: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(phases, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows: list[tuple] = []
                doc, queue, begin, n, ids = (part.column(c).to_pylist() for c in range(5))
                for d, q, b, total, x in zip(doc, queue, begin, n, ids, strict=True):
                    for start, place, length in windows.spans(q, b, total):
                        while length:
                            size = min(length, sequence - place % sequence)
                            raw = x[2 * start : 2 * (start + size)]
                            rows.append((d, start, size, zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes()), total, place // sequence, place % sequence, raw))
                            start, place, length = start + size, place + size, length - size
                columns = list(zip(*rows, strict=True)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], names=[x.strip().split(" ")[0] for x in _PIECE.split(",")])

    return run


def pack(docs: DataFrame, path: str, end_id: int = END_ID, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, targets: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The pieces of all docs (doc_id, text, source): where each lies in its document and its sequence, and its ids (16-bit)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    queued = stash(rows.mapInArrow(lean(_enqueue(path, end_id)), _QUEUED), "queued")
    sums = stash(queued.groupBy("source", "pid").agg(F.sum("n").alias("n")), "sums")
    sources = sums.groupBy("source").agg(F.sum("n").alias("n"))
    found = sources.orderBy(F.col("source").asc_nulls_first()).collect()  # one row a source
    names, totals = [r["source"] for r in found], [r["n"] for r in found]
    phases = by_temperature(totals, temperature) if targets is None else plan(totals, [float(targets.get(s, 0)) for s in names])
    ids = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "q_source string, queue int")
    if len(names) <= QUEUES:
        ids = F.broadcast(ids)
    placed = sums.join(ids, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("pid", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    bases = placed.select(F.col("pid").alias("b_pid"), F.col("source").alias("b_source"), "queue", F.coalesce(before, F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    located = queued.join(bases, (F.col("pid") == F.col("b_pid")) & F.col("source").eqNullSafe(F.col("b_source")))
    located = located.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("begin"), "n", "ids")
    return located.mapInArrow(lean(_cut(phases, sequence, sequence * window_sequences)), _PIECE)


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path()).drop("ids")
