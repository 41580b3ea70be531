"""Token ids in Arrow stream files: fixed-size lists, so any sequence and its mask are a zero-copy view.

A file holds record batches of BATCH sequences with three columns: `ids`, a fixed-size list of SEQUENCE unsigned 16-bit ids;
`mask`, a fixed-size list of bytes that hold one bit for each id, the lowest first (0 for the padding at the file's end); and `docs`, for the documents that begin in the sequence
their doc_id, place in it and number of ids. Documents follow each other without gaps in ascending doc_id order,
within and across files, so the place of any id in the whole corpus is the file's base plus its place.

One shuffle by ranges of doc_id orders the texts; each range is encoded and written by its task, a batch at a time. A file gets its
name only when it is complete, so a task that runs again or twice leaves the same file. The manifest has a row for each file.

Texts are encoded as the library does by itself: the string of an added token in a text becomes that token.

Defined results: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids go by their text's hash; repeated
rows are written each; very long texts go through batch by batch; ties (equal doc_id and text) are alike, so their order shows nowhere; an empty table gives no file and no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import encoder, tokenizer_path
from .shared import documents, lean, new_path

SEQUENCE = 2048
BATCH = 64
END_ID = 0

_DOC = pa.struct([("doc_id", pa.int64()), ("offset", pa.int32()), ("n", pa.int64())])
_MANIFEST = "pid int, name string, n_docs long, n_tokens long, n_sequences long"


def mask_bytes(sequence: int) -> int:
    return -(-sequence // 8)


def unpacked(mask: np.ndarray, sequence: int = SEQUENCE) -> np.ndarray:
    """A mask's bits as booleans (a copy)."""
    return np.unpackbits(mask, count=sequence, bitorder="little").astype(bool)


def schema(sequence: int = SEQUENCE) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), sequence)), ("mask", pa.list_(pa.uint8(), mask_bytes(sequence))), ("docs", pa.list_(_DOC))], metadata={"sequence": str(sequence)})


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Writer:
    """Writes documents' ids to one file, a batch at a time."""

    def __init__(self, sink, sequence: int = SEQUENCE, batch: int = BATCH):
        self.sequence, self.room = sequence, sequence * batch
        self.out = pa.ipc.new_file(sink, schema(sequence))
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, place among the held ids, number of ids
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.held, len(ids)))
        self.n_docs += 1
        self.n_tokens += len(ids)
        while len(ids):
            some = ids[: self.room - self.held]
            self.parts.append(some)
            self.held += len(some)
            ids = ids[len(some) :]
            if self.held == self.room:
                self._flush()

    def _flush(self) -> None:
        n = -(-self.held // self.sequence)
        values = np.zeros(n * self.sequence, "<u2")
        values[: self.held] = np.concatenate(self.parts)
        mask = np.packbits((np.arange(n * self.sequence) < self.held).reshape(n, self.sequence), axis=1, bitorder="little").ravel()
        row = np.array([d[1] // self.sequence for d in self.docs], np.int64)
        offs = np.searchsorted(row, np.arange(n + 1))
        docs = pa.StructArray.from_arrays([pa.array([d[0] for d in self.docs], pa.int64()), pa.array([d[1] % self.sequence for d in self.docs], pa.int32()), pa.array([d[2] for d in self.docs], pa.int64())], fields=list(_DOC))
        self.out.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(values), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), mask_bytes(self.sequence)), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), docs)],
                schema=schema(self.sequence),
            )
        )
        self.n_sequences += n
        self.parts, self.held, self.docs = [], 0, []

    def close(self) -> None:
        if self.held:
            self._flush()
        self.out.close()


@dataclass
class Reader:
    """Random access to the sequences of one file."""

    file: pa.ipc.RecordBatchFileReader
    batch: int = BATCH

    @classmethod
    def open(cls, uri: str) -> Reader:
        fs, path = file_system(uri)
        return cls(pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)))

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (one bit each, see `unpacked`) of sequence k, both views of the file."""
        b = self.file.get_batch(k // self.batch)
        row = k % self.batch
        ids, mask = (b.column(c).values.to_numpy(zero_copy_only=True)[row * n : (row + 1) * n] for c in (0, 1) if (n := b.schema.field(c).type.list_size))
        return ids, mask

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place in the file, ids) of every document, a batch in memory at a time."""
        at = 0  # ids of the batches before
        doc: tuple[int | None, int, int] | None = None
        parts: list[np.ndarray] = []
        missing = 0
        for k in range(self.file.num_record_batches):
            b = self.file.get_batch(k)
            size = b.schema.field(0).type.list_size
            values = b.column(0).values.to_numpy(zero_copy_only=True)
            if doc and missing:
                some = values[:missing]
                parts.append(some)
                missing -= len(some)
                if not missing:
                    yield doc[0], doc[1], np.concatenate(parts)
            lists = b.column(2)
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.values
            for row, doc_id, offset, n in zip(rows.tolist(), flat.field(0).to_pylist(), flat.field(1).to_pylist(), flat.field(2).to_pylist(), strict=True):
                start = row * size + offset
                some = values[start : start + n]
                doc, parts, missing = (doc_id, at + start, n), [some], n - len(some)
                if not missing:
                    yield doc_id, at + start, some
            at += len(values)


def _write(folder: str, path: str, end_id: int, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = file_system(folder)
        name = f"part-{task.partitionId():06d}.arrow"
        draft = f"{root}/.{name}.{task.taskAttemptId()}"
        enc, end = encoder(path), np.array([end_id], "<u2")
        writer = sink = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(draft)
                    writer = Writer(sink, sequence)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u2"), end]))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"pid": pa.array([task.partitionId()], pa.int32()), "name": [name], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_sequences": [writer.n_sequences]})

    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> list[dict]:
    """Write all docs' ids to files in folder (a URI that all machines reach); the manifest, in order, with each file's base."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    ordered = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    manifest = sorted((r.asDict() for r in ordered.mapInArrow(lean(_write(folder, path, end_id, sequence)), _MANIFEST).collect()), key=lambda r: r["pid"])
    base = 0
    for r in manifest:
        r["base"] = base
        base += r["n_tokens"]
    return manifest


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                before = 0
                for doc_id, at, ids in Reader.open(f"{folder}/{name}").documents():
                    if at != before:
                        raise ValueError(f"{name}: a gap at {before}")
                    before += len(ids)
                    rows.append((doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 20000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """One row for each document in the files: its place in the corpus, number of ids and their checksum."""
    if not manifest:
        return spark.createDataFrame([], _READ)
    files = spark.createDataFrame([(r["name"], r["base"]) for r in manifest], "name string, base long").repartition(len(manifest))
    return files.mapInArrow(lean(_read(folder)), _READ)


def op8_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "arrow")
    return read(spark, folder, write(documents(spark, sf_dir), folder, tokenizer_path()))
