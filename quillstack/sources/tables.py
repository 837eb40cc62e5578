"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table below ``root``; columns are pruned and filters pushed down by the plan that uses it."""
    return spark.read.parquet(f"{root}/{name}.parquet")
