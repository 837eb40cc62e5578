"""Queries on newly written text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.newtext import new_text
from quillstack.sources.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return new_text(table(spark, root, "emails")).select("id", F.explode("new_lines").alias("line_no")).distinct()


def p3_text(spark: SparkSession, root: str) -> DataFrame:
    return new_text(table(spark, root, "emails")).select("id", "new_text")


QUERIES = {"p3_found": p3_found, "p3_text": p3_text}
#: Alignment has no SQL; the tests use small threads with known new lines.
ORACLE: dict[str, str] = {}
