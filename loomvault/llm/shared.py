"""What the operators share: written intermediate tables, new column names, the documents, and workers that hand memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import new_path, shared_folder

__all__ = ["documents", "fresh", "lean", "new_path", "shared_folder", "stash"]

#: Bytes of an Arrow batch between Spark and Python; Spark's own default, of 64 MB, is taken for nobody's choice.
BATCH, _KEY, _DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its worker gives free memory back: Spark keeps workers for later tasks, which may need theirs in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        _give_back()

    return run


def _small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches are of BATCH bytes, unless someone has set another size."""
    if spark.conf.get(_KEY, _DEFAULT) == _DEFAULT:
        spark.conf.set(_KEY, BATCH)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, so lost executors cost nothing."""
    spark = df.sparkSession
    _small_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
