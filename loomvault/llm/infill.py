"""Fill-in-the-middle: texts cut at two token ranks and put together again with marks.

A token is a run of ASCII letters or one other character, so it begins wherever a character is no letter or the one before it is
none: a predicate of two adjacent bytes, without a pattern. Cuts are found by overlapping chunks:

1. A text is cut into chunks of CHUNK bytes. Each chunk also sees the last byte before it, so its counts of token starts and of code
   points need nothing of any other chunk; a block of chunks is counted at once.
2. Prefix sums over the chunks give the number of tokens of each text, hence the two ranks, and the chunk that owns each.
3. Only the owning chunks are scanned again, for the places of their ranks.

No row needs another, so there is no shuffle: texts are worked where they are read, 1 MB or one text at a time.

Defined results: a null text is empty, and an empty text is plain; a null doc_id stands for an empty string where ranks are drawn; repeated
rows give equal rows; very long texts are cut like others; a text that holds a mark stays plain; an empty table gives an empty table; extra
columns are ignored by `op12_*` and kept by `transform`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import documents, fresh, lean

#: Bytes of a chunk, and of a block of them that is counted at once.
CHUNK, BLOCK = 1 << 14, 1 << 20

# The marks, and the percentages of texts that are cut at all and that begin with their suffix.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SPM = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _marks(buf: np.ndarray, a: int, b: int, begins: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes [a, b): where tokens begin, where code points begin. One byte before a is read; begins: a is a text's first."""
    lead = (buf[a:b] & 0xC0) != 0x80
    letter = _LETTER[buf[max(a - 1, 0) : b]]
    before = letter[:-1] if a else np.concatenate([[False], letter[:-1]])
    now = letter[1:] if a else letter
    start = lead & ~(now & before)
    if begins and b > a:
        start[0] = True
    return start, lead


class Cutter:
    """Chunks of a run of texts with prefix sums of their token starts and code points."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, chunk: int = CHUNK, block: int = BLOCK):
        self.buf = buf
        per_text = -(-np.diff(offs) // chunk)
        #: Each text's first chunk, and the end.
        self.first = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.at = np.append(np.repeat(offs[:-1], per_text) + within * chunk, offs[-1]).astype(np.int64)
        self.begins = within == 0
        tokens, points = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        i, n = 0, len(self.at) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(self.at, self.at[i] + block, "right")) - 1))
            start, lead = _marks(buf, int(self.at[i]), int(self.at[j]), True)
            inner = self.at[i:j] - self.at[i]
            start[inner[self.begins[i:j]]] = True
            start[0] |= self.begins[i]
            if not self.begins[i]:  # the block begins inside a text
                start[0] = _marks(buf, int(self.at[i]), int(self.at[i]) + 1, False)[0][0]
            tokens[i + 1 : j + 1], points[i + 1 : j + 1] = np.add.reduceat(start.astype(np.int64), inner), np.add.reduceat(lead.astype(np.int64), inner)
            i = j
        self.tokens, self.points = np.cumsum(tokens), np.cumsum(points)

    def counts(self) -> np.ndarray:
        """Tokens of each text."""
        return np.diff(self.tokens[self.first])

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """Byte offset in the buffer and code points before it, where `rank` tokens of the text have ended."""
        a, b = int(self.first[text]), int(self.first[text + 1])
        want = int(self.tokens[a]) + rank
        if want >= self.tokens[b]:
            return int(self.at[b]), int(self.points[b] - self.points[a])
        owner = int(np.searchsorted(self.tokens, want, "right")) - 1
        start, lead = _marks(self.buf, int(self.at[owner]), int(self.at[owner + 1]), bool(self.begins[owner]))
        inside = int(np.flatnonzero(start)[want - int(self.tokens[owner])])
        return int(self.at[owner]) + inside, int(self.points[owner] - self.points[a]) + int(lead[:inside].sum())


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that the seed and a document's number decide."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))  # type: ignore[return-value]


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if form == "psm" else SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text from an output. Marks share no beginning with another's end, so each is found where it was put."""
    if form == "plain":
        return output
    first, second = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    a, rest = output[len(PREFIX) :].split(first, 1)
    b, middle = rest.split(second, 1)
    return a + middle + b if form == "psm" else b + middle + a


def rows(keys: list, column: pa.Array, seed: int, rate: int, spm: int) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    for base, buf, offs in K.text_chunks(column):
        cut = Cutter(buf, offs)
        n = cut.counts().tolist()
        for i in range(len(n)):
            raw = buf[offs[i] : offs[i + 1]].tobytes()
            h1, h2, h3, h4 = draws("" if keys[base + i] is None else str(keys[base + i]), seed)
            if not raw or h3 % 100 >= rate or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
                yield n[i], "plain", None, None, raw
                continue
            low, high = sorted((h1 % (n[i] + 1), h2 % (n[i] + 1)))
            (p, p_chars), (q, q_chars) = cut.place(i, low), cut.place(i, high)
            p, q, form = p - int(offs[i]), q - int(offs[i]), "spm" if h4 % 100 < spm else "psm"
            yield n[i], form, p_chars, q_chars - p_chars, joined(form, raw[:p], raw[p:q], raw[q:])


#: Rows and bytes of output that a task hands on at once.
_ROWS, _BYTES = 1_000, 4 << 20
_TYPES = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}


def _run(column: int, key: int, seed: int, rate: int, spm: int, out: dict[str, pa.DataType], finish, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, size = 0, [], 0
            found = rows(batch.column(key).to_pylist(), batch.column(column), seed, rate, spm)
            for k, (*facts, text) in enumerate(found, 1):
                held.append((*facts, *finish(text, facts[1])))
                size += len(text)
                if len(held) >= _ROWS or size >= _BYTES or k == batch.num_rows:
                    own = batch.slice(done, len(held)).columns if keep else [batch.column(key).slice(done, len(held))]
                    made = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), out.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, *made], names=[*(batch.schema.names if keep else ["doc_id"]), *out])
                    done, held, size = k, [], 0

    return run


def transform(docs: DataFrame, seed: int = 1, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with fim_n, fim_form, fim_prefix_chars, fim_middle_chars and fim_text (underscores are added to names that docs has)."""
    names = {fresh(docs, f"fim_{c}"): t for c, t in (*_TYPES.items(), ("text", pa.string()))}
    lower = [c.lower() for c in docs.columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{k} {'string' if pa.types.is_string(t) else 'long'}" for k, t in names.items())])
    return docs.mapInArrow(lean(_run(lower.index("text"), lower.index("doc_id"), seed, rate, spm, names, lambda text, _: (text.decode(),), True)), schema)


def op12_chunked_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, sizes and digests of every document's output, and of the text restored from it."""
    digests = _TYPES | {"output_sha256": pa.string(), "restored_sha256": pa.string()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return docs.mapInArrow(lean(_run(1, 0, 1, RATE, SPM, digests, lambda text, form: (sha(text), sha(restore(text, form))), False)), schema)


#: DuckDB's own way to op12: the tokens as a list.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, w, len(w)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
v AS (SELECT doc_id, text, w, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT doc_id, text, n, form, array_to_string(w[1:p], '') AS a, array_to_string(w[p+1:q], '') AS b, array_to_string(w[q+1:], '') AS c FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM x
"""
