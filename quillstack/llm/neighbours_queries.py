"""Queries on most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.neighbours import nearest_items, neighbour_pairs, usable
from quillstack.sources.tables import table


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbour_pairs(nearest_items(usable(table(spark, root, "content_embeddings"))))


QUERIES = {"p5_found": p5_found}
#: An approximate search has no equal SQL; its recall is held against brute force in the tests.
ORACLE: dict[str, str] = {}
