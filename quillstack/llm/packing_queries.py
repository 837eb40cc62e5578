"""Queries on filled containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.packing import CAPACITY, pack, token_counts
from quillstack.sources.tables import table


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return pack(token_counts(table(spark, root, "documents")))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens held and the share of room left over."""
    used = p8_containers(spark, root).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return used.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), (1 - F.try_divide(F.sum("used"), F.count(F.lit(1)) * CAPACITY)).alias("left_over"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
#: Many packings are right; the tests check that none overflows, nothing is lost and little room is left.
ORACLE: dict[str, str] = {}
