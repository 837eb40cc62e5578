"""Queries of changes, integrity, caches, mail parsing and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstack.operators import mail as M
from quillstack.operators import upserts as U
from quillstack.operators.lineage import shared_dir
from quillstack.operators.windows import latest
from quillstack.plans.book import Book
from quillstack.streaming import ingest

book = Book()
q = book.query


@q("select source_type, source_id, max_by(id, (coalesce(created_at, timestamp '0001-01-01'), id)) as id, count(*) as versions from content_unified group by 1, 2")
def sink_upserted_content(t):
    """Content by business key, the latest row winning."""
    at = F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    return t.content_unified.groupBy("source_type", "source_id").agg(F.max_by("id", F.struct(at, "id")).alias("id"), F.count("*").alias("versions"))


@q("with h as (select sha256(concat_ws(':', source_type, lower(trim(coalesce(title, ''))), trim(coalesce(body, '')))) as h, min(id) as id from content_unified group by 1) select h, id from h")
def sink_added_content(t):
    h = F.sha2(F.concat_ws(":", "source_type", F.lower(F.trim(F.coalesce("title", F.lit("")))), F.trim(F.coalesce("body", F.lit("")))), 256)
    return t.content_unified.groupBy(h.alias("h")).agg(F.min("id").alias("id"))


@q("select (select count(*) from emails) as total, (select count(distinct message_id) from emails e where not exists (select 1 from email_entities x where x.message_id = e.message_id)) as inserted, (select count(*) from emails) - (select count(distinct message_id) from emails e where not exists (select 1 from email_entities x where x.message_id = e.message_id)) as ignored")
def sink_insert_report(t):
    return U.insert_report(t.email_entities, t.emails, ["message_id"])


@q("select id, case when source_type = 'document' then true else ready_for_embedding end as ready, case when source_type = 'document' then len(list_filter(regexp_split_to_array(trim(coalesce(body, '')), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) else 0 end as n_words from content_unified")
def sink_updated_flags(t):
    words = F.size(F.filter(F.split(F.trim(F.coalesce("body", F.lit(""))), r"[ \t\n\r\f]+"), lambda w: w != "")).cast("long")
    rows = t.content_unified.select("id", "source_type", "body", F.col("ready_for_embedding").alias("ready"), F.lit(0).cast("long").alias("n_words"))
    return U.updated(rows, F.col("source_type") == "document", {"ready": F.lit(True), "n_words": words}).select("id", "ready", "n_words")


@q("select id, source_type from content_unified where id not in (select content_id from deleted_content where content_id is not null)")
def sink_deleted(t):
    gone = t.deleted_content.select(F.col("content_id").alias("id"))
    return U.deleted(t.content_unified.select("id", "source_type"), gone, ["id"])


@q("select file_path, string_agg(text_content, chr(10) order by chunk_index, chunk_id) as text, count(*) as n from (select distinct file_path, chunk_id, chunk_index, text_content from document_chunks where text_content is not null) group by 1")
def sink_joined_chunks(t):
    """Whole texts of files from their chunks in order."""
    rows = t.document_chunks.where("text_content is not null").select("file_path", "chunk_id", "chunk_index", "text_content").distinct()
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text_content")))
    return rows.groupBy("file_path").agg(F.array_join(F.transform(parts, lambda p: p["text_content"]), "\n").alias("text"), F.count("*").alias("n"))


@q("select chunk_id, case when coalesce(attempt_count, 0) >= 3 then null else processed_at + to_minutes(power(2, coalesce(attempt_count, 0))::int) end as due_at, coalesce(attempt_count, 0) >= 3 as permanent from document_chunks where status = 'failed'")
def sink_retry_state(t):
    return U.retry_state(t.document_chunks.where("status = 'failed'")).select("chunk_id", "due_at", "permanent")


@q("select chunk_id from document_chunks where status = 'failed' and processed_at < timestamp '2026-01-01' - interval 30 day")
def sink_purgeable(t):
    return t.document_chunks.where(F.col("status") == "failed").where("processed_at < timestamp_ntz '2026-01-01' - interval 30 days").select("chunk_id")


@q("select content_pair_hash, created_time + interval 24 hour as expires_at, coalesce(created_time + interval 24 hour < timestamp '2026-01-01', false) as expired from similarity_cache")
def cache_expiry(t):
    return U.with_expiry(t.similarity_cache, "created_time", 24).select("content_pair_hash", "expires_at", "expired")


@q("select least(a, b) as a, greatest(a, b) as b, max_by(s, (coalesce(ts, timestamp '0001-01-01'), s)) as score from (select try_cast(trim(content_id_1) as bigint) as a, try_cast(trim(content_id_2) as bigint) as b, similarity_score as s, created_time as ts from similarity_cache) where a is not null and b is not null and s is not null group by 1, 2")
def cache_latest_scores(t):
    from quillstack.operators.graph import pair_id

    a, b = pair_id(F.col("content_id_1")), pair_id(F.col("content_id_2"))
    rows = t.similarity_cache.where(a.isNotNull() & b.isNotNull() & F.col("similarity_score").isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.coalesce("created_time", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.col("similarity_score").alias("score"))
    return latest(rows, ["a", "b"], [F.col("at"), F.col("score")]).select("a", "b", "score")


_CHECKS = {
    "chunks": ("document_chunks", "true"), "chunks_without_hash": ("document_chunks", "sha256 is null"), "chunks_failed": ("document_chunks", "status = 'failed'"), "chunks_empty": ("document_chunks", "coalesce(length(trim(text_content)), 0) = 0"),
    "content": ("content_unified", "true"), "content_without_hash": ("content_unified", "sha256 is null"), "content_without_title": ("content_unified", "title is null"), "content_without_time": ("content_unified", "created_at is null"), "content_empty": ("content_unified", "coalesce(length(trim(body)), 0) = 0"),
    "embeddings": ("content_embeddings", "true"), "embeddings_without_vector": ("content_embeddings", "vector is null"), "embeddings_of_other_length": ("content_embeddings", "vector is not null and cardinality(vector) <> dim"),
    "mails": ("emails", "true"), "mails_without_thread": ("emails", "thread_id is null"), "mails_empty": ("emails", "coalesce(length(trim(content)), 0) = 0"), "mentions": ("email_entities", "true"), "mentions_reversed": ("email_entities", "end_char <= start_char"), "mentions_out_of_range": ("email_entities", "confidence < 0 or confidence > 1"),
}


@q(" union all ".join(f"select '{k}' as metric, count(*) filter ({w.replace('cardinality(vector)', 'len(vector)')}) as n from {tab}" for k, (tab, w) in _CHECKS.items()))
def integrity_counts(t):
    """All counts of the document-to-vector chain, one pass per table."""
    out = None
    for name in dict.fromkeys(tab for tab, _ in _CHECKS.values()):
        mine = {k: w for k, (tab, w) in _CHECKS.items() if tab == name}
        one = getattr(t, name).agg(*[F.count_if(F.expr(w)).alias(k) for k, w in mine.items()])
        long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in mine])).alias("m")).select("m.*")
        out = long if out is None else out.unionByName(long)
    return out


@q("select 'content' as tab, count(*) as n_keys, coalesce(sum(n - 1), 0)::bigint as surplus from (select source_type, source_id, count(*) as n from content_unified group by 1, 2 having count(*) > 1) union all select 'chunks', count(*), coalesce(sum(n - 1), 0)::bigint from (select chunk_id, count(*) as n from document_chunks group by 1 having count(*) > 1) union all select 'mails', count(*), coalesce(sum(n - 1), 0)::bigint from (select message_id, count(*) as n from emails group by 1 having count(*) > 1)")
def integrity_duplicates(t):
    def one(name, rows, keys):
        d = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        return d.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus")).select(F.lit(name).alias("tab"), "n_keys", "surplus")

    return one("content", t.content_unified, ["source_type", "source_id"]).unionByName(one("chunks", t.document_chunks, ["chunk_id"])).unionByName(one("mails", t.emails, ["message_id"]))


@q("select d.sha256, count(distinct d.chunk_id) as n_chunks, count(distinct c.id) as n_content, count(distinct e.id) as n_embeddings from document_chunks d left join content_unified c on c.sha256 = d.sha256 left join content_embeddings e on e.content_id = c.id where d.sha256 is not null group by 1")
def integrity_trace(t):
    """Chunks, content and embeddings of every hash; each side is counted before they meet."""
    chunks = t.document_chunks.where("sha256 is not null").groupBy("sha256").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    vectors = t.content_embeddings.groupBy(F.col("content_id").alias("id")).agg(F.countDistinct("id").alias("k"))
    content = t.content_unified.where("sha256 is not null").select("id", "sha256").join(vectors, "id", "left").groupBy("sha256").agg(F.countDistinct("id").alias("n_content"), F.sum(F.coalesce("k", F.lit(0))).alias("n_embeddings"))
    return chunks.join(content, "sha256", "left").select("sha256", "n_chunks", F.coalesce("n_content", F.lit(0)).alias("n_content"), F.coalesce("n_embeddings", F.lit(0)).alias("n_embeddings"))


@q("select violation, count(*) as n from (select unnest(list_filter([case when message_id is null then 'no id' end, case when recipient_to is null then 'no recipient' end, case when datetime_utc is null then 'no date' end, case when thread_id is null then 'no thread' end, case when coalesce(trim(content), '') = '' then 'empty' end, case when coalesce(trim(subject), '') = '' then 'no subject' end], lambda x: x is not null)) as violation from emails) group by 1")
def integrity_violations(t):
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {"no id": F.col("message_id").isNull(), "no recipient": F.col("recipient_to").isNull(), "no date": F.col("datetime_utc").isNull(), "no thread": F.col("thread_id").isNull(), "empty": blank("content"), "no subject": blank("subject")}
    found = F.explode(F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda v: v.isNotNull()))
    return t.emails.select(found.alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@q("select id, coalesce(title, 'Untitled') as title, coalesce(source_type, 'unknown') as source_type, coalesce(sha256, sha256(coalesce(body, ''))) as sha256 from content_unified")
def integrity_filled(t):
    return t.content_unified.select("id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"), F.coalesce("sha256", F.sha2(F.coalesce("body", F.lit("")), 256)).alias("sha256"))


@q("select e.message_id, min(e.id) as id from emails e where not exists (select 1 from content_unified c where c.source_type = 'email_message' and '<' || c.source_id || '>' = e.message_id) group by 1")
def integrity_mails_to_add(t):
    known = t.content_unified.where("source_type = 'email_message'").select(F.concat(F.lit("<"), "source_id", F.lit(">")).alias("message_id"))
    return t.emails.join(known, "message_id", "left_anti").groupBy("message_id").agg(F.min("id").alias("id"))


_STOPS = r"'^\s*(>|On .* wrote:\s*$|From: |-+ ?Original Message|-+ ?Forwarded message|Begin forwarded message)'"


@q(f"with l as (select id, string_split(coalesce(content, ''), chr(10)) as ls from emails), p as (select id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, {_STOPS})), true) as k from l) select id, case when coalesce(k, 0) = 0 then array_to_string(ls, chr(10)) when k = 1 then '' else array_to_string(ls[1:k - 1], chr(10)) end as reply from p")
def mail_reply_text(t):
    return t.emails.select("id", M.reply_text("content").alias("reply"))


@q()
def mail_conversations(t):
    return M.conversation(t.emails.select("id", F.col("content").alias("text")))


@q()
def mail_chunks(t):
    return M.chunks(t.documents.select(F.col("doc_id").alias("id"), "text"))


@q("select coalesce(thread_id, message_id) as place, count(*) as n, min(id) as first_id from emails group by 1")
def mail_groups(t):
    return t.emails.groupBy(F.coalesce("thread_id", "message_id").alias("place")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@q("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def stream_hourly_counts(t):
    """The windowed stream worked off to its end equals the batch count. Counts of open windows are updated batch by batch; the last update holds."""
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = ingest.windowed_counts(ingest.arriving(t.spark, f"{t.root}/events.parquet*", t.events.schema), "ts", "event_type", late="30 days")
    ingest.run_available(stream, ingest.updates(f"{path}/out"), f"{path}/state", "update")
    latest = ingest.latest_updates(t.spark, f"{path}/out", ["window_start", "event_type"])
    return latest.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@q("select message_id from emails where message_id is not null and trim(coalesce(content, '')) <> '' group by 1")
def stream_synced_mails(t):
    """Mails synced from landing files, each message once."""
    path = f"{shared_dir(t.spark)}/sync-{uuid.uuid4().hex}"
    ingest.sync_mails(t.spark, f"{t.root}/emails.parquet*", t.emails.schema, path, f"{path}/state", late="90 days")
    return t.spark.read.parquet(f"{path}/mails").select("message_id").distinct()


QUERIES, ORACLE = book.queries, book.oracle
