"""Queries on abusive content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.abuse import THRESHOLD, abuse_scores
from quillstack.sources.tables import table


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    return abuse_scores(table(spark, root, "documents"), table(spark, root, "doc_labels"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_scores(spark, root).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    """Documents, abusive ones and their share per source."""
    bad = (F.col("score") >= THRESHOLD).cast("int")
    return p10_scores(spark, root).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(bad).alias("n_abusive"), F.avg(bad).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates, "p10_scores": p10_scores}
#: A trained model has no SQL; the tests measure accuracy on held-out verdicts.
ORACLE: dict[str, str] = {}
