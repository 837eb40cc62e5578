"""Queries of the reference report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.operators.references import orphan_report, orphans, sides_of
from quillstack.sources.tables import table


def _sides(spark: SparkSession, root: str) -> list[DataFrame]:
    return sides_of(*(table(spark, root, t) for t in ("document_chunks", "content_unified", "content_embeddings")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans(_sides(spark, root)).select("ref_table", "ref_id").distinct()


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(_sides(spark, root))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

_REFS = """
with chunk as (select chunk_id, processed_at as ts, nullif(lower(trim(sha256)), '') as h from document_chunks),
docs as (select id, created_at as ts, nullif(lower(trim(sha256)), '') as h from content_unified where source_type = 'document'),
refs as (
  select 'document_chunks' as ref_table, chunk_id as ref_id, ts, h as k from chunk where h is not null
  union all select 'content_unified', cast(id as varchar), ts, h from docs where h is not null
  union all select 'content_embeddings', cast(id as varchar), created_at, cast(content_id as varchar) from content_embeddings where content_id is not null),
parents as (
  select 'document_chunks' as ref_table, ts, h as k from docs where h is not null
  union all select 'content_unified', ts, h from chunk where h is not null
  union all select 'content_embeddings', created_at, cast(id as varchar) from content_unified),
keys as (select distinct ref_table, k from refs),
stat as (
  select c.ref_table, c.k, count(p.ref_table) as n, count(*) filter (p.ref_table is not null and p.ts is null) as undated, min(p.ts) as first_at
  from keys c left join parents p on p.ref_table = c.ref_table and (p.k = c.k or (c.ref_table <> 'content_embeddings' and left(p.k, 16) = left(c.k, 16) and (length(p.k) <= 16 or length(c.k) <= 16)))
  group by 1, 2),
judged as (
  select r.ref_table, r.ref_id, r.ts, case when s.n = 0 then 'missing' when s.undated = 0 and s.first_at > r.ts + interval 24 hours then 'late' end as reason
  from refs r join stat s on s.ref_table = r.ref_table and s.k = r.k)
"""
ORACLE = {
    "p4_found": _REFS + "select distinct ref_table, ref_id from judged where reason is not null",
    "p4_report": _REFS + """select ref_table, strftime(ts, '%Y-%m') as period, count(*) as n_refs,
  count(*) filter (reason = 'missing') as n_missing, count(*) filter (reason = 'late') as n_late from judged group by 1, 2""",
}
