"""Queries on variant names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.names import name_groups, variant_pairs
from quillstack.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return variant_pairs(name_groups(table(spark, root, "email_entities")))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    """A row per spelling with its group: the pairs follow from these."""
    return name_groups(table(spark, root, "email_entities"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
#: The longest common subsequence has no SQL function; the tests hold it against brute force.
ORACLE: dict[str, str] = {}
