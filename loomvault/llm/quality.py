"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths over whole texts in numpy measure how many characters lie inside duplicated
n-grams and duplicated lines. Each document is judged alone, so the plan is one scan and one map: no shuffle.

Defined results: a null or empty text has no words and fails the base rule; ties do not arise; repeated rows are judged
each for itself; an empty table gives an empty table; extra columns are ignored (`measure`) or kept (`keep`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .shared import documents, lean

#: Largest share of a text's word characters inside duplicated n-grams, by n.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of a text's word characters inside lines equal to an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS = 10
REPEAT_WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _repeated(words: np.ndarray, first: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """By n, which words lie in an n-word window that stands twice or more in its row.

    A repeated window starts with a repeated window of any smaller n, so each length looks only at what the one before left.
    """
    left = None
    for k in NGRAM_LIMITS:
        start, h = K.windows(words, first, k)
        if left is not None:
            at = np.isin(start, left, assume_unique=True, kind="table") if len(start) else np.zeros(0, bool)
            start, h = start[at], h[at]
        twice, _ = K.repeats(h ^ K.mix(row[start].astype(np.uint64) + np.uint64(1)))
        left = start[twice]
        yield k, K.covered(left, k, len(words))


def _lines(w: K.Words, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, byte start, byte end) of the lines that hold a word and equal an earlier line of their row."""
    breaks = np.flatnonzero(w.buf == 10)
    row_of_break = np.searchsorted(offs, breaks, "right") - 1
    start = np.concatenate([offs[:-1], breaks + 1])
    row = np.concatenate([np.arange(w.n_rows), row_of_break])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty_like(start)
    last = np.ones(len(start), bool)
    last[:-1] = row[1:] != row[:-1]
    end[:-1] = start[1:] - 1
    end[last] = offs[1:][row[last]]
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[full], end[full], row[full]
    h = K.span_hashes(w.buf, start, end) ^ K.mix(row.astype(np.uint64) + np.uint64(1))
    _, later = K.repeats(h)
    return row[later], np.stack([start[later], end[later]])


def measure_chunk(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each row of a run of texts."""
    w = K.Words(buf, offs)
    n, h = len(w), w.hashes()
    chars = K.code_points(buf, w.start, w.end)
    marks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SYMBOL[buf], out=marks[1:])
    out = {"n_words": w.counts(), "word_chars": _sums(chars, w.first), "n_symbols": marks[offs[1:]] - marks[offs[:-1]]}
    rows, spans = _lines(w, offs)
    out["n_dup_lines"] = np.bincount(rows, minlength=w.n_rows).astype(np.int64)
    a, b = np.searchsorted(w.start, spans[0]), np.searchsorted(w.start, spans[1])
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, a, 1)
    np.add.at(depth, b, -1)
    out["dup_line_chars"] = _sums(chars * (np.cumsum(depth[:-1]) > 0), w.first)
    for k, inside in _repeated(h, w.first, w.row):
        if k == REPEAT_WINDOW:
            out["n_repeat_words"] = _sums(inside, w.first)
        out[f"dup_{k}gram_chars"] = _sums(chars * inside, w.first)
    total = np.maximum(out["word_chars"], 1)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    bad = out["base_failed"] | (out["dup_line_chars"] > LINE_LIMIT * total)
    for k, limit in NGRAM_LIMITS.items():
        bad = bad | (out[f"dup_{k}gram_chars"] > limit * total)
    out["kept"] = ~bad
    return out


_NAMES = [x.strip().split(" ")[0] for x in _SCHEMA.split(",")]


def _measures(texts: pa.ChunkedArray | pa.Array) -> dict[str, np.ndarray]:
    parts = [measure_chunk(buf, offs) for _, buf, offs in K.text_chunks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in _NAMES[1:]}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            m = _measures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in _NAMES[1:])], names=_NAMES)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array(_measures(batch.column(at))["kept"]))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and verdict of every row of docs (columns doc_id, text)."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(_measure), _SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    return docs.mapInArrow(lean(_keep), docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))


def _coverage_sql(n: int) -> str:
    """Words and their characters inside n-grams that stand twice or more in their text, by document."""
    return (
        f"g{n} AS (SELECT doc_id, unnest(range(i, i + {n})) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM "
        f"(SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w))) WHERE c > 1), "
        f"c{n} AS (SELECT doc_id, count(*) AS n, sum(length(ws[i])) AS chars FROM (SELECT DISTINCT doc_id, i FROM g{n}) JOIN w USING (doc_id) GROUP BY doc_id)"
    )


#: DuckDB SQL for the rows of op2_quality_rules.
ORACLE_SQL = (
    "WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), "
    "ls AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM w)), "
    "dl AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM ls "
    "WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) WHERE r > 1 GROUP BY doc_id), "
    + ", ".join(map(_coverage_sql, NGRAM_LIMITS))
    + ", m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, "
    "coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(c5.n, 0)::BIGINT AS n_repeat_words, coalesce(dl.chars, 0)::BIGINT AS dup_line_chars, "
    + ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in NGRAM_LIMITS)
    + " FROM w LEFT JOIN dl USING (doc_id) "
    + " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in NGRAM_LIMITS)
    + f"), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m) "
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed "
    + f"OR dup_line_chars > {LINE_LIMIT}e0 * greatest(word_chars, 1) "
    + " ".join(f"OR dup_{n}gram_chars > {limit}e0 * greatest(word_chars, 1)" for n, limit in NGRAM_LIMITS.items())
    + ") AS kept, dup_line_chars, "
    + ", ".join(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)
    + " FROM b"
)
