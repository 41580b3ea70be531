"""A vault made of the documents table: one note each, as the same SQL text for Spark and for DuckDB, but for the padding of numbers.

DuckDB's text shortens numbers of more than six digits, so from doc_id 1,000,000 on its paths are not unique; Spark's are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Notes link to the note of this many that their number leads to.
LINKED = 1000


def padded(number: str) -> str:
    """Six digits at least, and all that a longer number has."""
    return f"lpad({number},greatest(6,length({number})),'0')"


def projection_sql(text: str, pad: Callable[[str], str] = lambda number: f"lpad({number},6,'0')") -> str:
    """SELECT path, content FROM documents. text: the name of the string type; pad: the expression that pads a number's text."""
    s = f"cast(doc_id AS {text})"
    doc = lambda n: f"concat('doc',{pad(f'cast({n} AS {text})')})"
    nl = "chr(10)"
    return (
        f"SELECT doc_id, concat(source,'/',lang,'/',{doc('doc_id')},'.md') AS path, concat("
        f"'---',{nl},CASE WHEN doc_id%4=3 THEN '' ELSE concat('title: Document ',{s},{nl}) END,'tags:',{nl},'  - lang/',lang,{nl},'  - source/',source,{nl},'---',{nl},"
        f"'# Note ',{s},{nl},{nl},'See [[',{doc(f'(doc_id*7+3)%{LINKED}')},']] #bucket/b',cast(doc_id%5 AS {text}),{nl},"
        f"CASE WHEN doc_id%3=0 THEN concat('Also [[',source,'/',{doc(f'(doc_id+1)%{LINKED}')},'#Body|next]] and ![[pic',{s},'.png]]',{nl}) ELSE '' END,"
        f"CASE WHEN doc_id%4=1 THEN concat('[site](./other',{s},'.md \"A title\") <https://example.com/',{s},'> <user',{s},'@example.com> `#code` #123',{nl}) ELSE '' END,"
        f"{nl},'## Body',{nl},{nl},text,{nl},{nl},'### Notes ##',{nl},{nl},"
        f"'- [',CASE WHEN doc_id%3=0 THEN 'x' WHEN doc_id%3=1 THEN ' ' ELSE '-' END,'] review ',lang,{nl},'  - [>] forward #todo',{nl}) AS content FROM documents"
    )


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of the projected notes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return spark.sql(projection_sql("string", padded).replace("FROM documents", "FROM {documents}"), documents=docs)
