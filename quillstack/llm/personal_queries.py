"""Queries on personal information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.personal import personal_items, redacted
from quillstack.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return personal_items(table(spark, root, "emails")).select("id", "field_name", "pii_type", "pii_text").distinct()


def p1_redacted(spark: SparkSession, root: str) -> DataFrame:
    return redacted(table(spark, root, "emails"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
#: A trained model has no SQL; the tests measure held-out accuracy.
ORACLE: dict[str, str] = {}
