"""Queries of joins, anti joins and chains between content, chunks, embeddings and mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import text as X
from quillstack.operators import windows as O
from quillstack.operators.skew import many_to_one
from quillstack.plans.book import Book

book = Book()
q = book.query


@q("select e.id, e.entity_text, e.entity_type, m.datetime_utc from email_entities e join (select distinct message_id, min(datetime_utc) as datetime_utc from emails group by 1) m using (message_id) where e.confidence >= 0.9")
def join_mentions_to_mails(t):
    mails = t.emails.groupBy("message_id").agg(F.min("datetime_utc").alias("datetime_utc"))
    return many_to_one(t.email_entities.where("confidence >= 0.9").select("id", "message_id", "entity_text", "entity_type"), mails, "message_id").select("id", "entity_text", "entity_type", "datetime_utc")


@q("select c.source_type, count(*) as n, count(e.content_id) as n_embedded, round(count(e.content_id) * 100.0 / count(*), 6) as coverage from content_unified c left join (select distinct content_id from content_embeddings where content_id is not null) e on e.content_id = c.id group by 1")
def join_coverage_by_type(t):
    have = t.content_embeddings.where("content_id is not null").select(F.col("content_id").alias("id"), F.lit(1).alias("e")).distinct()
    return t.content_unified.select("id", "source_type").join(have, "id", "left").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.count("e").alias("n_embedded"), F.round(F.count("e") * 100.0 / F.count(F.lit(1)), 6).alias("coverage"))


@q("select id, source_type from content_unified c where not exists (select 1 from content_embeddings e where e.content_id = c.id)")
def join_not_embedded(t):
    return t.content_unified.join(t.content_embeddings.select(F.col("content_id").alias("id")), "id", "left_anti").select("id", "source_type")


@q("select id, content_id from content_embeddings where content_id is not null and content_id not in (select id from content_unified where id is not null)")
def join_embeddings_not_in(t):
    return t.content_embeddings.where("content_id is not null").join(t.content_unified.select(F.col("id").alias("content_id")), "content_id", "left_anti").select("id", "content_id")


@q("select message_id, entity_text from email_entities x where not exists (select 1 from emails e where e.message_id = x.message_id and e.content_hash is null) and not exists (select 1 from emails e where e.sender = x.entity_text)")
def join_not_exists_either(t):
    a = t.emails.where("content_hash is null").select("message_id")
    b = t.emails.select(F.col("sender").alias("entity_text"))
    return t.email_entities.join(a, "message_id", "left_anti").join(b, "entity_text", "left_anti").select("message_id", "entity_text")


_BOTH = "select 'chunk' as side, lower(trim(d.sha256)) as h, count(*) as n from document_chunks d where d.sha256 is not null and not exists (select 1 from content_unified c where lower(trim(c.sha256)) = lower(trim(d.sha256))) group by 2 union all select 'content', lower(trim(c.sha256)), count(*) from content_unified c where c.source_type = 'document' and c.sha256 is not null and not exists (select 1 from document_chunks d where lower(trim(c.sha256)) = lower(trim(d.sha256))) group by 2"


@q(_BOTH)
def join_orphans_both_sides(t):
    h = F.lower(F.trim("sha256")).alias("h")
    chunks = t.document_chunks.where("sha256 is not null").select(h)
    content = t.content_unified.where("sha256 is not null").select("source_type", h)
    left = chunks.join(content, "h", "left_anti").groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunk").alias("side"), "h", "n")
    right = content.where("source_type = 'document'").join(chunks, "h", "left_anti").groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(F.lit("content").alias("side"), "h", "n")
    return left.unionByName(right)


@q("select count(distinct d.sha256) as n_missing from document_chunks d join content_unified c on c.sha256 = d.sha256 where not exists (select 1 from content_embeddings e where e.content_id = c.id)")
def join_chain_missing_tail(t):
    content = t.content_unified.join(t.content_embeddings.select(F.col("content_id").alias("id")), "id", "left_anti").select("sha256")
    return t.document_chunks.select("sha256").join(content, "sha256", "left_semi").agg(F.countDistinct("sha256").alias("n_missing"))


@q("select d.chunk_id, c.id as content_id, e.id as embedding_id, e.created_at from document_chunks d join content_unified c on c.sha256 = d.sha256 join content_embeddings e on e.content_id = c.id where e.created_at is not null order by e.created_at desc, e.id, d.chunk_id, c.id limit 1")
def join_chain_latest(t):
    """The latest whole chain of chunk, content and embedding. Every table is reduced to one row a key before it is joined."""
    newest = lambda *ties: F.min_by(F.struct("created_at", *ties), F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), *ties))
    embedded = t.content_embeddings.where("created_at is not null and content_id is not null").withColumnRenamed("id", "embedding_id").groupBy("content_id").agg(newest("embedding_id").alias("e")).select("content_id", "e.*")
    contents = t.content_unified.where("sha256 is not null").select(F.col("id").alias("content_id"), "sha256").join(embedded, "content_id").groupBy("sha256").agg(newest("embedding_id", "content_id").alias("c")).select("sha256", "c.*")
    chunks = t.document_chunks.where("sha256 is not null").groupBy("sha256").agg(F.min("chunk_id").alias("chunk_id"))
    return chunks.join(contents, "sha256").orderBy(F.desc("created_at"), "embedding_id", "chunk_id", "content_id").limit(1).select("chunk_id", "content_id", "embedding_id", "created_at")


@q("select distinct d.chunk_id from document_chunks d where d.sha256 is not null and exists (select 1 from content_unified c where c.sha256 = d.sha256 and c.chunk_index = d.chunk_index)")
def join_composite_key(t):
    return t.document_chunks.join(t.content_unified.select("sha256", "chunk_index"), ["sha256", "chunk_index"], "left_semi").select("chunk_id").distinct()


@q("select d.chunk_id, min(c.sha256) as full_hash from (select distinct chunk_id, sha256 from document_chunks where length(sha256) = 16) d join content_unified c on left(c.sha256, 16) = d.sha256 and length(c.sha256) = 64 group by 1")
def join_cut_hashes(t):
    """Cut hashes and the full hash they stand for: an equi join on the first 16 characters."""
    cut = t.document_chunks.where("length(sha256) = 16").select("chunk_id", F.col("sha256").alias("stem")).distinct()
    full = t.content_unified.where("length(sha256) = 64").groupBy(F.substring("sha256", 1, 16).alias("stem")).agg(F.min("sha256").alias("full_hash"))
    return cut.join(full, "stem").groupBy("chunk_id").agg(F.min("full_hash").alias("full_hash"))


@q("select left(sha256, 4) as stem, count(distinct sha256) as n from document_chunks where sha256 is not null group by 1 having count(distinct sha256) > 1")
def join_ambiguous_stems(t):
    return t.document_chunks.where("sha256 is not null").groupBy(F.substring("sha256", 1, 4).alias("stem")).agg(F.countDistinct("sha256").alias("n")).where("n > 1")


@q("with good as (select title, min(id) as good_id from content_unified where title is not null and length(coalesce(body, '')) > 0 group by 1) select c.id, good_id from content_unified c join good using (title) where length(coalesce(c.body, '')) = 0")
def join_empty_to_filled(t):
    size = F.length(F.coalesce("body", F.lit("")))
    good = t.content_unified.where(F.col("title").isNotNull() & (size > 0)).groupBy("title").agg(F.min("id").alias("good_id"))
    return many_to_one(t.content_unified.where(size == 0).select("id", "title"), good, "title").select("id", "good_id")


@q("select regexp_replace(lower(title), '[ _]', '', 'g') as k, count(*) as n, min(id) as first_id, count(distinct title) as spellings from content_unified where title is not null group by 1 having count(*) > 1")
def join_same_title(t):
    """Rows whose titles differ in blanks and underscores only, as groups; pairs need not be spelled out."""
    k = F.regexp_replace(F.lower("title"), "[ _]", "")
    return t.content_unified.where("title is not null").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.countDistinct("title").alias("spellings")).where("n > 1")


@q("select c.id from content_unified c left join deleted_content d on d.content_id = c.id and d.source_type = 'document' where d.content_id is null")
def join_not_deleted(t):
    gone = t.deleted_content.where("source_type = 'document'").select(F.col("content_id").alias("id"))
    return t.content_unified.join(gone, "id", "left_anti").select("id")


@q("select count(distinct e.content_id) as n from content_embeddings e join content_unified c on c.id = e.content_id")
def join_live_embeddings(t):
    return t.content_embeddings.join(t.content_unified.select(F.col("id").alias("content_id")), "content_id", "left_semi").agg(F.countDistinct("content_id").alias("n"))


@q("select e.id, e.content_id, e.dim, e.model from content_embeddings e join content_unified c on c.id = e.content_id where c.source_type = 'email_message'")
def join_embeddings_of_type(t):
    mails = t.content_unified.where("source_type = 'email_message'").select(F.col("id").alias("content_id"))
    return t.content_embeddings.join(mails, "content_id", "left_semi").select("id", "content_id", "dim", "model")


@q("select e.id, e.content_id, coalesce(c.title, m.subject, 'unknown') as title, case when c.id is not null then 'content' when m.id is not null then 'mail' else 'none' end as found_in from content_embeddings e left join content_unified c on c.id = e.content_id left join emails m on m.id = e.content_id")
def join_enriched_hits(t):
    """Every hit with the title of its content row, else of the mail of that number, else none."""
    hits = t.content_embeddings.select("id", "content_id")
    content = t.content_unified.select(F.col("id").alias("content_id"), "title", F.lit(1).alias("c"))
    mails = t.emails.select(F.col("id").alias("content_id"), "subject", F.lit(1).alias("m"))
    both = hits.join(content, "content_id", "left").join(mails, "content_id", "left")
    return both.select("id", "content_id", F.coalesce("title", "subject", F.lit("unknown")).alias("title"), F.when(F.col("c").isNotNull(), "content").when(F.col("m").isNotNull(), "mail").otherwise("none").alias("found_in"))


@q("with s as (select floor(epoch(created_at))::bigint as sec, count(*) as n from content_unified where created_at is not null group by 1) select a.sec as at_second, a.n, ((select sum(b.n) from s b where b.sec between a.sec and a.sec + 86400) - 1)::bigint as later from s a")
def join_within_a_day(t):
    return O.within_seconds(t.content_unified, "created_at")


@q("with x as (select id, created_at as ts from content_unified where created_at is not null), p as (select min_by(id, (ts, id)) as id, min(ts) as ts from x where id >= 100) select x.id, abs(date_diff('day', p.ts::date, x.ts::date)) as days from x, p where x.id <> p.id and x.ts between p.ts - interval 7 day and p.ts + interval 7 day")
def join_around_one(t):
    """Content within seven days of one item, by distance."""
    x = t.content_unified.where("created_at is not null").select("id", F.col("created_at").alias("at"))
    one = x.where("id >= 100").agg(F.min(F.struct("at", "id")).alias("p"))
    near = x.crossJoin(F.broadcast(one)).where("id <> p.id and at between p.at - interval 7 days and p.at + interval 7 days")
    return near.select("id", F.abs(F.datediff("at", "p.at")).cast("long").alias("days"))


@q("""with m as (select message_id, entity_text, start_char, end_char from email_entities where entity_type in ('PERSON', 'ORG') and start_char is not null group by all),
n as (select *, lead(entity_text) over w as next_text, lead(start_char) over w as next_start from m window w as (partition by message_id order by start_char, end_char, entity_text))
select message_id, entity_text, next_text, next_start - end_char as gap from n where next_start - end_char between 0 and 100""")
def join_adjacent_mentions(t):
    """Each mention with the next one of its mail, if at most 100 characters lie between."""
    m = t.email_entities.where("entity_type in ('PERSON', 'ORG') and start_char is not null").select("message_id", "entity_text", "start_char", "end_char").distinct()
    w = O.Window.partitionBy("message_id").orderBy("start_char", "end_char", "entity_text")
    n = m.withColumn("next_text", F.lead("entity_text").over(w)).withColumn("next_start", F.lead("start_char").over(w))
    return n.where("next_start - end_char between 0 and 100").select("message_id", "entity_text", "next_text", (F.col("next_start") - F.col("end_char")).alias("gap"))


@q(r"""select a.address as sender, b.address as recipient, count(*) as n from (select id, lower(trim(case when regexp_extract(sender, '<([^<>]+)>', 1) <> '' then regexp_extract(sender, '<([^<>]+)>', 1) else sender end)) as address from emails) a
join (select id, lower(trim(unnest(string_split(recipient_to, ',')))) as address from emails where recipient_to is not null) b using (id) where b.address <> '' group by 1, 2""")
def join_sender_recipient(t):
    to = F.explode(F.split("recipient_to", ","))
    rows = t.emails.select("id", X.header_address("sender").alias("sender"), to.alias("r")).select("sender", F.lower(F.trim("r")).alias("recipient")).where("recipient != ''")
    return rows.groupBy("sender", "recipient").agg(F.count(F.lit(1)).alias("n"))


@q("""with m as (select thread_id, id, sender, datetime_utc as ts, row_number() over (partition by thread_id order by datetime_utc, id) as k, count(*) over (partition by thread_id) as n from emails where thread_id is not null and datetime_utc is not null)
select id, thread_id, sender from m where k = n and n > 1""")
def join_unanswered(t):
    """Last messages of threads that had others before."""
    m = t.emails.where("thread_id is not null and datetime_utc is not null")
    g = m.groupBy("thread_id").agg(F.max_by(F.struct("id", "sender"), F.struct("datetime_utc", "id")).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.select("last.id", "thread_id", "last.sender")


@q("""with o as (select c.c_custkey, count(o_orderkey) as n, coalesce(sum(o_totalprice), 0) as total from customer c left join orders on o_custkey = c.c_custkey group by 1) select n, count(*) as customers, round(sum(total), 2) as total from o group by 1""")
def join_customer_orders(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    j = t.customer.select("c_custkey").join(o, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))
    return j.groupBy("n").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("total"), 2).alias("total"))


@q("select n_name, r_name, count(*) as suppliers, round(sum(s_acctbal), 2) as balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def join_star(t):
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # 25 rows at every scale
    return t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@q("select matter_id, count(*) as n_docs, count(distinct doc_type) as n_types, min(created_at) as first_at, max(created_at) as last_at, round(avg(n_chars), 6) as mean_chars from documents where matter_id is not null group by 1")
def join_matter_summary(t):
    return t.documents.where("matter_id is not null").groupBy("matter_id").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("doc_type").alias("n_types"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


QUERIES, ORACLE = book.queries, book.oracle
