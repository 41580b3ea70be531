"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame; `run` writes each
stage's rows as Parquet into the shared folder and hands the next stage what it reads back. All but the last return the
columns of documents, in their order and whatever further columns there are.

Defined results for all stages: an empty table gives an empty table; nulls are allowed in every column; very long texts are read whole.
What a stage does with null and empty texts, repeated rows and ties stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvault.llm import decontaminate, jaccard, packing, quality, secrets
from loomvault.llm.encode import tokenizer_path
from loomvault.llm.shared import documents, fresh, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has fewer words than the rules ask for, so it goes; repeated rows are judged each by itself.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the row with the smallest doc_id stays.

    A null doc_id comes after all others, ties go by the text's hash; rows equal in doc_id and text are one; texts without a word stay.
    """
    return jaccard.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: rows of their doc_id and text, not others that share the doc_id (or have none).

    Null and empty texts hold none and stay; an empty benchmark lets all stay.
    """
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    doc, text = fresh(docs, "leak_id"), fresh(docs, "leak_hash")
    leaks = stash(found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (decontaminate.text_hash() == F.col(text))
    return docs.join(leaks, same, "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay, those with null and empty texts as they are."""
    return secrets.redact(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything left is packed into sequences; a null or empty text is its end id, repeated rows are packed each, a null source is a source."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture_packing", mixture_packing),
]

#: SQL cannot express the decontamination, secret and packing stages; tests/llm/test_pipeline.py has a brute-force version of the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
