"""Benchmark decontamination by templates.

Texts are canonicalised: words are stripped of outer punctuation and lower-cased, and numbers, units after numbers and names
(capitalised words inside a sentence) become typed placeholders whose values are kept as slots. Windows of WINDOW template words
are hash-joined between documents and benchmark items. Matched windows of one document and item are lined up by the distance
of their places, and slots must agree: a benchmark value may stand for one document value only along a line, so a question
re-parameterised throughout is caught while a chance likeness of template words is not.

Beside them stand literal windows: the lower-cased words as they are, without slots and however many placeholders they hold. They find every
verbatim copy, whatever its case and the text around it, also of items that are in capitals, in Title Case or mostly numbers. Template windows
without a slot are literal windows, so only those with one are template windows.

At scale: the benchmark's window hashes become a bit filter of bounded size, so documents emit only windows that have a
partner (no text is shuffled, and nothing grows with the documents), and the join and the grouping are over those few rows. A
window is one row for a document however often it stands there with equal slots, and one for an item, with all its places. Copies of a document or an
item are one text; what is found is handed to each.

A window that many items share (an instruction that stands before every question) would pair every document with every item. So each item
sets aside its commonest windows, as many as do not cover enough words by themselves: whatever covers enough has another window too, and
only those others make pairs. The windows set aside are then looked up for these pairs alone. Pairs with enough words in common are results, however many.

Defined results: null or empty texts and items have no windows and give no row; an item of fewer than WINDOW words is matched
as a whole, however short it is; repeated words give no further rows, and a template window that is repeated with equal slots lies on the line of its first places; very long texts are read whole; equal rows of documents give one result row for each distinct (doc_id, text); an empty
table on either side gives an empty table; extra columns are ignored. Words are what white space separates; letters are folded where both cases
have UTF-8 forms of one length (so not ß and SS). Re-parameterised forms are found where the template keeps half of its words literal.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitfilter
from . import kernels as K
from .shared import documents, lean, stash
from .streams import runs

WINDOW = 8
#: A window needs this share of words that are no placeholders.
LITERAL = 0.5
#: Words of an item that its windows must cover in a document (all, if it has fewer).
COVER = 13
#: Items that share a window from which on it may be set aside.
COMMON = 8

#: Words that are units where a number stands before them.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg ton tons lb lbs pound pounds oz ml l liter "
    "liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "% percent degrees mph kmh dollar dollars cent cents euro euros usd eur"
).split()

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:|\"'(")] = True
_LETTER = _ALNUM & ~_DIGIT
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x1F3D5B79, 0x2F3D5B79, 0x3F3D5B79))


def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    points = np.arange(1 << 16)
    for c in range(128, 1 << 16):
        low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
        if len(low) == 1 and len(low.encode()) == len(chr(c).encode()):
            points[c] = ord(low)
    return points[: 1 << 11].copy(), points


_FOLD2, _FOLD3 = _fold_tables()


def fold(buf: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes with letters beyond ASCII in lower case, wherever that has as many bytes."""
    out = buf.copy()
    two = np.flatnonzero((buf[:-1] >= 0xC2) & (buf[:-1] < 0xE0))
    c = _FOLD2[(buf[two] & 0x1F).astype(np.int64) << 6 | buf[two + 1] & 0x3F]
    out[two], out[two + 1] = c >> 6 | 0xC0, c & 0x3F | 0x80
    three = np.flatnonzero((buf[:-2] >= 0xE0) & (buf[:-2] < 0xF0))
    c = _FOLD3[(buf[three] & 0x0F).astype(np.int64) << 12 | (buf[three + 1] & 0x3F).astype(np.int64) << 6 | buf[three + 2] & 0x3F]
    out[three], out[three + 1], out[three + 2] = c >> 12 | 0xE0, c >> 6 & 0x3F | 0x80, c & 0x3F | 0x80
    return out


def _letters_and_digits(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: not those of ASCII punctuation, nor of U+0080-00BF, U+2000-207F and U+3000-303F (quotes, dashes)."""
    out = _ALNUM[buf]
    at = np.flatnonzero(buf[:-1] == 0xC2)
    out[at] = out[at + 1] = False
    at = np.flatnonzero((buf[:-2] == 0xE2) | (buf[:-2] == 0xE3))
    at = at[np.where(buf[at] == 0xE2, (buf[at + 1] == 0x80) | (buf[at + 1] == 0x81), buf[at + 1] == 0x80)]
    out[at] = out[at + 1] = out[at + 2] = False
    return out


def _hash_words(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    return K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes(lower=True)


_UNIT_HASHES = np.sort(_hash_words(UNITS))


class Template:
    """Template words of a run of texts: their hash, value hash, whether they are slots, and each row's first."""

    __slots__ = ("capital", "first", "slot", "value", "word")

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        w = K.Words(buf, offs)
        alnum = np.flatnonzero(_letters_and_digits(buf))
        a, b = np.searchsorted(alnum, w.start), np.searchsorted(alnum, w.end)
        full = b > a
        start, end = alnum[a[full]], alnum[b[full] - 1] + 1
        raw_end, raw_start, row = w.end[full], w.start[full], w.row[full]
        self.first = np.searchsorted(row, np.arange(w.n_rows + 1)).astype(np.int64)
        self.value = K.span_hashes(fold(buf), start, end, lower=True)
        self.word = self.value.copy()
        if not len(start):
            self.slot = self.capital = np.zeros(0, bool)
            return
        count = lambda mask: np.concatenate([[0], np.cumsum(mask[buf])])
        digits, letters = count(_DIGIT), count(_LETTER)
        number = (digits[end] > digits[start]) & (letters[end] == letters[start])
        quantity = _DIGIT[buf[start]] & (letters[end] > letters[start])  # a number with its unit, as 5km
        after = np.zeros(len(start), bool)
        after[1:] = number[:-1] & (row[1:] == row[:-1])
        at = np.minimum(np.searchsorted(_UNIT_HASHES, self.value), len(_UNIT_HASHES) - 1)
        unit = after & (_UNIT_HASHES[at] == self.value)
        inner = np.zeros(len(start), bool)  # not first in its text, line or sentence
        inner[1:] = (row[1:] == row[:-1]) & ~_STOP[buf[raw_end[:-1] - 1]] & (buf[raw_start[1:] - 1] != 10)
        self.capital = _UPPER[buf[start]] & (end - start > 1) & ~number
        name = inner & self.capital
        self.slot = number | quantity | unit | name
        for mask, code in ((name, _NAME), (number | quantity, _NUM), (unit, _UNIT)):
            self.word[mask] = code

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of k words that have a slot, and enough literal words."""
        start, h = K.windows(self.word, self.first, k, seed=k)
        slots = self.slots(start, k)
        keep = (slots > 0) & (slots <= (1 - LITERAL) * k)
        return start[keep], h[keep]

    def slots(self, start: np.ndarray, k: int) -> np.ndarray:
        """Slots in each window."""
        total = np.concatenate([[0], np.cumsum(self.slot)])
        return total[start + k] - total[start]

    def literal_windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of k words as they are. Their seed keeps them apart from template windows."""
        return K.windows(self.value, self.first, k, seed=_LITERAL_SEED + k)

    def led(self) -> tuple[Template, np.ndarray]:
        """The templates of the texts inside a sentence, where a capitalised first word is a name; and those first words."""
        at = self.first[:-1][np.diff(self.first) > 0]
        at = at[self.capital[at] & ~self.slot[at]]
        other = copy(self)
        other.word, other.slot = self.word.copy(), self.slot.copy()
        other.word[at], other.slot[at] = _NAME, True
        return other, at


_LITERAL_SEED = 100
_ROW = "id long, th long, k int, pos long, n_words long, h long, literal boolean, slots array<long>, places array<long>"


def _lists(lists: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))


def _emit(template: Template, ids: pa.Array, hashes: pa.Array, base: int, k: int, row: np.ndarray, start: np.ndarray, h: np.ndarray, slots: list[np.ndarray], places: list[np.ndarray], literal: bool) -> pa.RecordBatch:
    """Rows of windows with their slots and places (see _places)."""
    at = pa.array(row + base)
    counts = np.diff(template.first)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(at), hashes.take(at), pa.array(np.full(len(row), k, np.int32)), pa.array(start - template.first[row]), pa.array(counts[row]),
            pa.array(h.view(np.int64)), pa.array(np.full(len(row), literal)), _lists(slots), _lists(places),
        ],
        names=["id", "th", "k", "pos", "n_words", "h", "literal", "slots", "places"],
    )


def _slot_values(template: Template, start: np.ndarray, k: int) -> list[np.ndarray]:
    return [template.value[s : s + k][template.slot[s : s + k]].view(np.int64) for s in start.tolist()]


def _once(row: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by row, hash and place, and where in it each row's hash begins."""
    order = np.lexsort((start, h, row))
    r, x = row[order], h[order]
    return order, np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])) if len(order) else np.zeros(0, np.int64)


def _with_slots(template: Template, start: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of template windows together with their slots."""
    masked = np.where(template.slot, template.value, np.uint64(0))
    out = h.copy()
    for i in range(k):
        out = K.mix(out * np.uint64(0x9E3779B97F4A7C15) + masked[start + i])
    return out


def _places(template: Template, row: np.ndarray, start: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the windows, those that are the first of their row and hash; for each, all places as 2 * place + (has no slot)."""
    if not len(start):
        return start, []
    order, head = _once(row, start, h)
    place = 2 * (start - template.first[row]) + (template.slots(start, k) == 0)
    return order[head], np.split(place[order], head[1:])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, buf, offs in K.text_chunks(batch.column(2)):
            t = Template(buf, offs)
            n = np.diff(t.first)
            rows = np.repeat(np.arange(len(n)), n)
            led, leads = t.led()
            for k in range(1, WINDOW + 1):
                fits = lambda start, k=k: n[rows[start]] >= WINDOW if k == WINDOW else n[rows[start]] == k  # noqa: B023, E731
                for of in (t, led):
                    start, h = of.windows(k)
                    fit = fits(start) & (np.isin(start, leads) if of is led else True)
                    start, h = start[fit], h[fit]
                    first, places = _places(of, rows[start], start, _with_slots(of, start, h, k), k)
                    start, h = start[first], h[first]
                    yield _emit(of, batch.column(0), batch.column(1), base, k, rows[start], start, h, _slot_values(of, start, k), places, False)
                start, h = t.literal_windows(k)
                start, h = start[fits(start)], h[fits(start)]
                if len(start):
                    first, places = _places(t, rows[start], start, h, k)
                    yield _emit(t, batch.column(0), batch.column(1), base, k, rows[start[first]], start[first], h[first], [_NONE] * len(first), places, True)


_NONE = np.zeros(0, np.int64)


def _set_aside(common: int):
    """Columns sorted by ith: the same with `aside`, the windows of an item, commonest first, that together do not cover enough of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 1):
            k, n, shared = (group.column(c).to_numpy() for c in ("ik", "item_words", "n_items"))
            lists = group.column("iplaces").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            cuts, places = lists.offsets.to_numpy(), lists.values.to_numpy() // 2
            need = min(COVER, int(n[0]))
            covered, aside, some = np.zeros(int(n[0]), bool), np.zeros(len(k), bool), 0
            for j in np.argsort(-shared, kind="stable").tolist():
                if shared[j] < common:
                    break
                more = np.unique((places[cuts[j] : cuts[j + 1], None] + np.arange(k[j])).ravel())
                if some + int((~covered[more]).sum()) < need:
                    covered[more], aside[j] = True, True
                    some = int(covered.sum())
            for b in group.append_column("aside", pa.array(aside)).combine_chunks().to_batches():
                yield b

    return run


def _document_windows(sizes: list[int], table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, buf, offs in K.text_chunks(batch.column(2)):
                t = Template(buf, offs)
                rows = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
                for k in sizes:
                    for (start, h), literal in ((t.windows(k), False), (t.literal_windows(k), True)):
                        hit = bitfilter.passes(table.value, h.view(np.int64))
                        start, h = start[hit], h[hit]
                        if len(start):
                            order, head = _once(rows[start], start, h if literal else _with_slots(t, start, h, k))
                            start, h = start[order[head]], h[order[head]]
                            none = [_NONE] * len(start)
                            yield _emit(t, batch.column(0), batch.column(1), base, k, rows[start], start, h, none if literal else _slot_values(t, start, k), none, literal)

    return run


_FOUND = "th long, ith long, n_windows long, covered_words long, item_words long, n_slots long, n_changed long, n_conflicts long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document and item whose literal windows, or consistent template windows, cover enough of the item (both together, without conflicts)."""
    out: list[tuple] = []
    for group in runs(batches, 2):
        text, item = (group.column(c)[0].as_py() for c in range(2))
        k, pos, ipos, n, literal = (group.column(c).to_numpy() for c in ("k", "pos", "ipos", "item_words", "literal"))
        slots, islots, places = (group.column(c).to_pylist() for c in ("slots", "islots", "iplaces"))
        covered, same = np.zeros(int(n[0]), bool), np.zeros(int(n[0]), bool)
        meaning: dict[tuple[int, int], int] = {}
        taken, conflicts = set(), 0
        for j in np.lexsort((ipos, pos - ipos)).tolist():
            if literal[j]:
                for place, plain in (divmod(x, 2) for x in places[j]):
                    same[place : place + k[j]] = True
                    if plain:
                        covered[place : place + k[j]] = True
                    taken.add(place)
                continue
            line = int(pos[j] - ipos[j])
            pairs = list(zip(islots[j], slots[j], strict=True))
            if any(meaning.get((line, a), b) != b for a, b in pairs) or len(dict(pairs)) != len(set(pairs)):
                conflicts += 1
                continue
            meaning.update({(line, a): b for a, b in pairs})
            for place in (x // 2 for x in places[j]):
                covered[place : place + k[j]] = True
                taken.add(place)
        total = int(max(covered.sum(), same.sum()) if conflicts else (covered | same).sum())
        if total >= min(COVER, int(n[0])):
            out.append((text, item, len(taken), total, int(n[0]), len(meaning), sum(a != b for (_, a), b in meaning.items()), conflicts))
    names = [x.strip().split(" ")[0] for x in _FOUND.split(",")]
    columns = list(zip(*out, strict=True)) if out else [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def text_hash() -> Column:
    """What tells texts of one doc_id apart: the text_hash of find."""
    return F.xxhash64(F.col("text").cast("string"))


def find(docs: DataFrame, benchmark: DataFrame, common: int = COMMON) -> DataFrame:
    """Rows (doc_id, text_hash, item_id, ...) of documents that hold a benchmark item or a re-parameterised form of it.

    common: items that share a window from which on it may be set aside; the result is the same with any.
    """
    spark = docs.sparkSession
    texts = lambda df, key: df.select(F.col(key).cast("long").alias("id"), text_hash().alias("th"), F.col("text").cast("string").alias("text"))
    items = stash(texts(benchmark, "item_id").mapInArrow(lean(_item_windows), _ROW), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # WINDOW values at most
    table = spark.sparkContext.broadcast(bitfilter.build(items.select("h"), bitfilter.bits_for(items.count())))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ours = items.select(F.col("th").alias("ith"), F.col("k").alias("ik"), F.col("pos").alias("ipos"), F.col("n_words").alias("item_words"), F.col("h").alias("ih"), F.col("literal").alias("iliteral"), F.col("slots").alias("islots"), F.col("places").alias("iplaces")).distinct()
    shared = ours.groupBy(F.col("ih").alias("sh")).agg(F.count_distinct("ith").alias("n_items"))
    counted = ours.join(shared, F.col("ih") == F.col("sh")).drop("sh").repartition(n, "ith").sortWithinPartitions("ith")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ours.schema.fields) + ", n_items long, aside boolean"
    ours = stash(counted.mapInArrow(lean(_set_aside(common)), schema).drop("n_items"), "windows")
    found = stash(texts(docs, "doc_id").mapInArrow(lean(_document_windows(sizes, table)), _ROW).drop("places"), "seen")
    seen = stash(found.select("th", "k", "pos", "h", "literal", "slots").distinct(), "seen_once")
    alike = (F.col("h") == F.col("ih")) & (F.col("k") == F.col("ik")) & (F.col("literal") == F.col("iliteral")) & (F.col("literal") | (F.size("slots") == F.size("islots")))
    judged = ["th", "ith", "k", "pos", "ipos", "item_words", "literal", "slots", "islots", "iplaces"]
    rare = stash(seen.join(ours.filter("not aside"), alike).select(*judged), "pairs")
    candidates = rare.select(F.col("th").alias("c_th"), F.col("ith").alias("c_ith")).distinct()
    wanted = candidates.join(ours.filter("aside"), F.col("c_ith") == F.col("ith"))
    common = seen.join(wanted, (F.col("th") == F.col("c_th")) & alike).select(*judged)
    hits = rare.unionByName(common).repartition(n, "th", "ith").sortWithinPartitions("th", "ith").mapInArrow(lean(_judge), _FOUND)
    hits = stash(hits, "found")
    of_doc = found.select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash")).distinct()
    of_item = items.select(F.col("id").alias("item_id"), F.col("th").alias("item_hash")).distinct()
    named = hits.join(of_item, F.col("ith") == F.col("item_hash")).join(of_doc, F.col("th") == F.col("text_hash"))
    return named.select("doc_id", "text_hash", "item_id", "n_windows", "covered_words", "item_words", "n_slots", "n_changed", "n_conflicts")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
    return found.withColumn("kind", F.when(F.col("n_changed") == 0, "verbatim").otherwise("re-parameterised"))
