"""Queries on scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.scans import repaired_texts, repairs
from quillstack.sources.tables import table


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return repairs(table(spark, root, "document_chunks")).select("chunk_id", "line_no", "kind", "word").distinct()


def p7_text(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "document_chunks")
    return repaired_texts(chunks, repairs(chunks))


QUERIES = {"p7_found": p7_found, "p7_text": p7_text}
#: Labelling and repair have no SQL; the tests use composed pages with known faults.
ORACLE: dict[str, str] = {}
