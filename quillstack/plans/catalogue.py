"""All queries of the core, by name, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("references", "filters", "graphs", "joins", "aggregates", "scalars", "vectors", "texts", "relations", "upkeep", "records")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"quillstack.plans.{name}"), what).items():
            if key in out:
                raise ValueError(f"two queries are named {key}")
            out[key] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return queries()["hybrid_search"](spark, root)
