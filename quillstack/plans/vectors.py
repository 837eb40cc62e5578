"""Queries of search, vectors, duplicates and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstack.functions import dates as D
from quillstack.functions import text as X
from quillstack.operators import copies as C
from quillstack.operators import vectors as V
from quillstack.plans.book import Book

book = Book()
q = book.query
_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_KW = "kw as (select doc_id as id, row_number() over (order by created_at desc nulls last, doc_id) as kw_rank from (select * from documents where contains(lower(text), 'ledger') order by created_at desc nulls last, doc_id limit 20))"
_SEM = f"sem as (select id, row_number() over (order by sim desc, id) as sem_rank from (select b.vec_id as id, round({_COS}, 9) as sim from embeddings a, embeddings b where a.vec_id = (select min(vec_id) from embeddings) and b.vec_id <> a.vec_id order by sim desc, id limit 20))"


def keyword_leg(t, word: str, k: int):
    hits = t.documents.where(X.has("text", word)).orderBy(F.desc_nulls_last("created_at"), "doc_id").limit(k)
    return hits.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(F.desc_nulls_last("created_at"), "doc_id")).alias("kw_rank"))


def vector_leg(t, k: int):
    v = vectors(t)
    one = v.join(F.broadcast(v.agg(F.min("id").alias("id"))), "id")
    hits = V.nearest(one, v, k)
    return hits.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("sim", 9)), "id")).alias("sem_rank"))


@q(f"with {_KW}, {_SEM} select coalesce(kw.id, sem.id) as id, coalesce(kw_rank, 0) as kw_rank, coalesce(sem_rank, 0) as sem_rank, round(coalesce(0.4 / (60 + kw_rank), 0) + coalesce(0.6 / (60 + sem_rank), 0), 9) as score from kw full outer join sem on kw.id = sem.id order by score desc, id limit 10")
def hybrid_search(t):
    """Keyword and vector hits fused by reciprocal ranks; both legs are limited before they are ranked."""
    both = keyword_leg(t, "ledger", 20).join(vector_leg(t, 20), "id", "full_outer")
    score = F.coalesce(0.4 / (60 + F.col("kw_rank")), F.lit(0.0)) + F.coalesce(0.6 / (60 + F.col("sem_rank")), F.lit(0.0))
    return both.select("id", F.coalesce(F.col("kw_rank").cast("long"), F.lit(0)).alias("kw_rank"), F.coalesce(F.col("sem_rank").cast("long"), F.lit(0)).alias("sem_rank"), F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@q("select id, k as place, round(1.0 / k, 9) as score from (select id, row_number() over (order by created_at desc nulls last, id) as k from (select * from content_unified where contains(lower(coalesce(title, '')), 'case') order by created_at desc nulls last, id limit 50))")
def search_ranked_keywords(t):
    hits = t.content_unified.where(X.has("title", "case")).orderBy(F.desc_nulls_last("created_at"), "id").limit(50)
    k = F.row_number().over(Window.orderBy(F.desc_nulls_last("created_at"), "id"))
    return hits.select("id", k.cast("long").alias("place"), F.round(1.0 / k, 9).alias("score"))


@q("""select id, round(0.6 * 0.5 + 0.3 * coalesce(least(1.0, greatest(0.0, exp(-date_diff('day', created_at::date, date '2026-01-01') / 30.0))), 0.5) + case when n > 0 then 0.01 else 0 end, 8) as score
from (select c.id, c.created_at, count(e.id) as n from content_unified c left join email_entities e on e.message_id = '<' || c.source_id || '>' where contains(lower(coalesce(c.body, '')), 'inspection') group by 1, 2) order by score desc, id limit 20""")
def search_reranked(t):
    hits = t.content_unified.where(X.has("body", "inspection")).select("id", "created_at", F.concat(F.lit("<"), "source_id", F.lit(">")).alias("message_id"))
    named = t.email_entities.groupBy("message_id").agg(F.count("*").alias("n"))
    score = 0.6 * 0.5 + 0.3 * D.recency(F.col("created_at")) + F.when(F.col("n") > 0, 0.01).otherwise(0.0)
    return hits.join(named, "message_id", "left").select("id", F.round(score, 8).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@q(f"select b.vec_id as id, round({_COS}, 8) as sim from embeddings a, embeddings b where a.vec_id = (select min(vec_id) from embeddings) and b.vec_id <> a.vec_id order by round({_COS}, 12) desc, id limit 10")
def vector_top(t):
    v = vectors(t)
    one = v.join(F.broadcast(v.agg(F.min("id").alias("id"))), "id")
    return V.nearest(one, v, 10).select("id", F.round("sim", 8).alias("sim"))


@q(f"select a.vec_id as query_id, b.vec_id as id, round({_COS}, 8) as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and {_COS} >= 0.3")
def vector_neighbours(t):
    """Stated queries (ids divisible by 100) against all vectors, in blocks."""
    v = vectors(t)
    return V.nearest(v.where("id % 100 = 0"), v, least=0.3).select("query_id", "id", F.round("sim", 8).alias("sim"))


@q("select id, content_id, round(sqrt(list_sum(list_transform(vector, lambda x: x::double * x::double))), 6) as size, abs(sqrt(list_sum(list_transform(vector, lambda x: x::double * x::double))) - 1) >= 0.01 as off from content_embeddings where vector is not null")
def vector_lengths(t):
    size = V.norm(F.col("vector"))
    return t.content_embeddings.where("vector is not null").select("id", "content_id", F.round(size, 6).alias("size"), (F.abs(size - 1) >= 0.01).alias("off"))


@q("select model, dim, count(*) as n, count(vector) as n_vectors, count(distinct content_id) as n_contents from content_embeddings group by 1, 2")
def vector_collections(t):
    return t.content_embeddings.groupBy("model", "dim").agg(F.count("*").alias("n"), F.count("vector").alias("n_vectors"), F.countDistinct("content_id").alias("n_contents"))


@q()
def vector_rescaled(t):
    return V.unit_vectors(t.content_embeddings.where("vector is not null")).groupBy("rescaled").agg(F.count("*").alias("n"), F.round(F.max(F.abs(V.norm(F.col("vector")) - 1)), 4).alias("furthest"))


@q(f"""with recursive p as (select a.vec_id as x, b.vec_id as y, {_COS} as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id where {_COS} >= 0.4),
core as (select x from p group by 1 having count(*) + 1 >= 3), link as (select p.x, p.y from p where x in (select x from core) and y in (select x from core)),
reach(x, y) as (select x, x from core union select r.x, l.y from reach r join link l on l.x = r.y), lab as (select x, min(y) as cluster from reach group by 1),
border as (select p.x, max_by(l.cluster, (p.sim, -p.y)) as cluster from p join lab l on l.x = p.y where p.x not in (select x from core) group by 1)
select vec_id as id, coalesce(lab.cluster, border.cluster, -1) as cluster from embeddings left join lab on lab.x = vec_id left join border on border.x = vec_id""")
def cluster_density(t):
    return V.dense_clusters(vectors(t), 0.4, 3)


@q("select label, count(*) as size, list_sort(list(vec_id))[1:10] as sample from embeddings group by 1")
def cluster_members(t):
    v = t.embeddings
    few = v.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("k <= 10").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("sample"))
    return v.groupBy("label").agg(F.count("*").alias("size")).join(few, "label").select("label", "size", "sample")


_T = r"trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'))"


@q(f"select sha256({_T}) as digest, count(*) as n, min(doc_id) as first_id from documents where {_T} <> '' group by 1 having count(*) > 1")
def copies_exact(t):
    return C.exact_copies(t.documents.select(F.col("doc_id").alias("id"), "text"))


@q()
def copies_near(t):
    return C.near_copies(t.documents.select(F.col("doc_id").alias("id"), "text"))


@q(f"with g as (select doc_id, sha256({_T}) as digest, created_at from documents where {_T} <> ''), k as (select digest, min_by(doc_id, (coalesce(created_at, timestamp '9999-01-01'), doc_id)) as keep_id from g group by 1) select doc_id, keep_id as duplicate_of from g join k using (digest) where doc_id <> keep_id")
def copies_to_remove(t):
    g = C.text_groups(t.documents.select(F.col("doc_id").alias("id"), "text")).join(t.documents.select(F.col("doc_id").alias("id"), "created_at"), "id")
    k = g.groupBy("digest").agg(F.min_by("id", F.struct(F.coalesce("created_at", F.lit("9999-01-01").cast("timestamp_ntz")), "id")).alias("keep_id"))
    return C.many_to_one(g, k, "digest").where("id <> keep_id").select(F.col("id").alias("doc_id"), F.col("keep_id").alias("duplicate_of"))


@q("select count(*) as n, count(distinct content_hash) as n_distinct, round(100.0 * (count(content_hash) - count(distinct content_hash)) / count(*), 6) as duplicate_share from emails")
def copies_share(t):
    return t.emails.agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("n_distinct"), F.round(100.0 * (F.count("content_hash") - F.countDistinct("content_hash")) / F.count("*"), 6).alias("duplicate_share"))


@q("select distinct e.id from emails e join content_unified c on lower(trim(c.sha256)) = lower(trim(e.content_hash))")
def copies_known_hashes(t):
    known = t.content_unified.select(F.lower(F.trim("sha256")).alias("h"))
    return t.emails.select("id", F.lower(F.trim("content_hash")).alias("h")).join(known, "h", "left_semi").select("id")


QUERIES, ORACLE = book.queries, book.oracle
