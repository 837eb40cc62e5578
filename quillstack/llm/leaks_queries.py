"""Queries on leaked evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.leaks import SHARE, leak_report, leaked
from quillstack.sources.tables import table


def _leaked(spark: SparkSession, root: str) -> DataFrame:
    return leaked(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaked(spark, root).where(f"held >= {SHARE}").select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    return leak_report(_leaked(spark, root))


QUERIES = {"p9_found": p9_found, "p9_report": p9_report}
#: Markup, entities and broken words have no equal in SQL; the tests compare with a plain search for shared runs of words.
ORACLE: dict[str, str] = {}
