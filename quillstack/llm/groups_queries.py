"""Queries on groups of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.groups import connected_groups, match_edges
from quillstack.sources.tables import table


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return connected_groups(match_edges(table(spark, root, "similarity_cache"))).select(F.col("id").alias("content_id"), "group_id")


QUERIES = {"p6_found": p6_found}

ORACLE = {"p6_found": """
with recursive m as (
  select distinct least(x, y) as a, greatest(x, y) as b from (
    select try_cast(trim(content_id_1) as bigint) as x, try_cast(trim(content_id_2) as bigint) as y from similarity_cache where similarity_score >= 0.7) t
  where x <> y),
e as (select a as x, b as y from m union all select b, a from m),
reach(x, y) as (select distinct x, x from e union select r.x, e.y from reach r join e on e.x = r.y)
select x as content_id, min(y) as group_id from reach group by 1"""}
