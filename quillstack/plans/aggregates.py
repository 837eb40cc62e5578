"""Queries of aggregates, ordered computations, top rows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstack.functions import dates as D
from quillstack.functions import text as X
from quillstack.operators import graph as G
from quillstack.operators import windows as O
from quillstack.plans.book import Book

book = Book()
q = book.query




@q("select coalesce(source_type, 'all') as source_type, count(*) as n, count(distinct sha256) as n_hashes from content_unified group by rollup (source_type)")
def agg_content_stats(t):
    """Counts per type and overall in one pass."""
    return t.content_unified.rollup("source_type").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("n_hashes")).withColumn("source_type", F.coalesce("source_type", F.lit("all")))


@q("select count(*) as n, count(*) filter (similarity_score is null) as unknown, min(created_time) as first_at, max(created_time) as last_at, round(avg(epoch(timestamp '2026-01-01') - epoch(created_time)) / 86400, 4) as mean_age from similarity_cache")
def agg_cache_stats(t):
    age = F.unix_seconds(F.lit(D.AS_OF).cast("timestamp")) - F.unix_micros(F.col("created_time").cast("timestamp")) / 1e6
    return t.similarity_cache.agg(F.count("*").alias("n"), F.count_if(F.col("similarity_score").isNull()).alias("unknown"), F.min("created_time").alias("first_at"), F.max("created_time").alias("last_at"), F.round(F.avg(age) / 86400, 4).alias("mean_age"))


@q("select entity_type, count(*) as n, count(distinct normalized_form) as n_forms, count(distinct message_id) as n_mails, round(avg(confidence), 8) as confidence from email_entities group by 1")
def agg_entity_types(t):
    return t.email_entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("normalized_form").alias("n_forms"), F.countDistinct("message_id").alias("n_mails"), F.round(F.avg("confidence"), 8).alias("confidence"))


@q("select count(distinct file_hash) as n_files, count(*) as n_chunks, sum(char_count)::bigint as n_chars, round(avg(char_count), 8) as mean_chars, count(ocr_confidence) as n_scored, round(avg(ocr_confidence), 8) as mean_score from document_chunks")
def agg_chunk_stats(t):
    return t.document_chunks.agg(F.countDistinct("file_hash").alias("n_files"), F.count("*").alias("n_chunks"), F.sum("char_count").alias("n_chars"), F.round(F.avg("char_count"), 8).alias("mean_chars"), F.count("ocr_confidence").alias("n_scored"), F.round(F.avg("ocr_confidence"), 8).alias("mean_score"))


@q("select extraction_method, status, count(*) as n from document_chunks group by 1, 2")
def agg_method_histogram(t):
    return t.document_chunks.groupBy("extraction_method", "status").agg(F.count("*").alias("n"))


@q("select count(*) as n_files, count(*) filter (n > 1) as n_split, round(avg(n), 8) as mean_chunks, max(n) as most from (select file_path, count(*) as n from document_chunks group by 1)")
def agg_chunks_per_file(t):
    per = t.document_chunks.groupBy("file_path").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_files"), F.count_if(F.col("n") > 1).alias("n_split"), F.round(F.avg("n"), 8).alias("mean_chunks"), F.max("n").alias("most"))


@q("select count(*) filter (attempt_count = 1) as once, count(*) filter (attempt_count = 2) as twice, count(*) filter (attempt_count >= 3) as often, round(coalesce(avg(attempt_count), 0), 8) as mean, count(distinct sha256) as n_hashes from document_chunks where status = 'failed'")
def agg_failed_attempts(t):
    a = F.col("attempt_count")
    return t.document_chunks.where("status = 'failed'").agg(F.count_if(a == 1).alias("once"), F.count_if(a == 2).alias("twice"), F.count_if(a >= 3).alias("often"), F.round(F.coalesce(F.avg(a), F.lit(0.0)), 8).alias("mean"), F.countDistinct("sha256").alias("n_hashes"))


@q("select sha256, count(*) as n_chunks, min(processed_at) as first_at, max(attempt_count) as attempts from document_chunks where status = 'failed' group by 1 order by attempts desc, first_at, sha256 limit 50")
def agg_quarantined(t):
    g = t.document_chunks.where("status = 'failed'").groupBy("sha256").agg(F.count("*").alias("n_chunks"), F.min("processed_at").alias("first_at"), F.max("attempt_count").alias("attempts"))
    return g.orderBy(F.desc("attempts"), F.asc_nulls_last("first_at"), F.asc_nulls_last("sha256")).limit(50)


@q("select case when error_message is null then 'none' when contains(lower(error_message), 'timeout') or contains(lower(error_message), 'timed out') then 'timeout' when contains(lower(error_message), 'password') or contains(lower(error_message), 'encrypt') then 'protected' when contains(lower(error_message), 'ocr') then 'ocr' when contains(lower(error_message), 'corrupt') then 'corrupt' else 'other' end as category, count(*) as n from document_chunks group by 1")
def agg_error_categories(t):
    m = "error_message"
    kind = F.when(F.col(m).isNull(), "none").when(X.any_has([m], ["timeout", "timed out"]), "timeout").when(X.any_has([m], ["password", "encrypt"]), "protected").when(X.has(m, "ocr"), "ocr").when(X.has(m, "corrupt"), "corrupt").otherwise("other")
    return t.document_chunks.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


@q("select source_type, source_id, count(*) as n, min(id) as keep_id from content_unified group by 1, 2 having count(*) > 1")
def agg_duplicate_keys(t):
    return t.content_unified.groupBy("source_type", "source_id").agg(F.count("*").alias("n"), F.min("id").alias("keep_id")).where("n > 1")


@q("select user_id, event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3 having count(*) > 2")
def agg_dense_days(t):
    return t.events.groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).where("n > 2")


@q("select count(*) as n, count(*) filter (thread_id is null) as without_thread, count(distinct thread_id) as n_threads, min(datetime_utc) as first_at, max(datetime_utc) as last_at from emails")
def agg_evidence_summary(t):
    return t.emails.agg(F.count("*").alias("n"), F.count_if(F.col("thread_id").isNull()).alias("without_thread"), F.countDistinct("thread_id").alias("n_threads"), F.min("datetime_utc").alias("first_at"), F.max("datetime_utc").alias("last_at"))


@q("select extract(hour from datetime_utc) as hour, count(*) as n, count(*) filter (contains(lower(coalesce(subject, '')), 'unit')) as units, count(*) filter (contains(lower(coalesce(subject, '')), 'follow up')) as followups, count(*) filter (regexp_matches(lower(trim(coalesce(subject, ''))), '^(re|reply|response):')) as replies from emails where datetime_utc is not null group by 1")
def agg_mail_hours(t):
    return t.emails.where("datetime_utc is not null").groupBy(F.hour("datetime_utc").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.count_if(X.has("subject", "unit")).alias("units"), F.count_if(X.has("subject", "follow up")).alias("followups"), F.count_if(X.is_reply("subject")).alias("replies"))


@q("select sender, count(*) as n from emails where sender is not null group by 1 order by n desc, sender limit 5")
def agg_top_senders(t):
    return t.emails.where("sender is not null").groupBy("sender").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender").limit(5)


@q(r"select doc_id, length(text) as n_chars, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')) as n_words, length(text) - length(replace(text, chr(10), '')) + 1 as n_lines from documents where text is not null")
def agg_text_metrics(t):
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != ""))
    return t.documents.where("text is not null").select("doc_id", F.length("text").cast("long").alias("n_chars"), words.cast("long").alias("n_words"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))


@q("select source_type, count(*) as n from content_unified where created_at >= (select max(created_at) from content_unified) - interval 7 day group by 1")
def agg_recent_activity(t):
    last = t.content_unified.agg(F.max("created_at").alias("last"))
    return t.content_unified.crossJoin(F.broadcast(last)).where("created_at >= last - interval 7 days").groupBy("source_type").agg(F.count("*").alias("n"))


@q("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 8) as discount, count(*) as n from lineitem group by 1, 2")
def agg_lineitems(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 8).alias("discount"), F.count("*").alias("n"))


# --- Ordered computations ---
@q("select id, 'EID-' || y || '-' || case when k < 10000 then lpad(k::varchar, 4, '0') else k::varchar end as eid from (select id, extract(year from datetime_utc) as y, row_number() over (partition by extract(year from datetime_utc) order by datetime_utc, id) as k from emails where datetime_utc is not null)")
def win_evidence_ids(t):
    dated = t.emails.where("datetime_utc is not null")
    return O.numbered(dated, "datetime_utc", ["id"]).select("id", "eid")


_SUBJ = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(subject, '')), '(?i)^re:\s*', ''), '(?i)^fwd:\s*', ''), '(?i)^fw:\s*', ''), '(?i)^reply:\s*', ''), '^\[[^\]]*\]\s*', '')))"


@q(f"select k as subject, min(datetime_utc) as first_at, count(*) as n, count(distinct thread_id) as n_threads from (select *, {_SUBJ} as k from emails) group by 1")
def win_subject_threads(t):
    k = X.bare_subject("subject")
    return t.emails.groupBy(k.alias("subject")).agg(F.min("datetime_utc").alias("first_at"), F.count("*").alias("n"), F.countDistinct("thread_id").alias("n_threads"))


@q("select id, next_id, round((epoch(next_at) - epoch(ts)) / 3600, 6) as hours, case when d < 1 then 1.0 when d < 7 then 0.7 when d < 30 then 0.5 when d < 365 then 0.3 else 0.1 end as strength from (select *, (epoch(next_at) - epoch(ts)) / 86400 as d from (select id, created_at as ts, lead(id) over (order by created_at, id) as next_id, lead(created_at) over (order by created_at, id) as next_at from content_unified where created_at is not null)) where next_id is not null")
def win_sequential_edges(t):
    seconds = (F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6
    return O.following(t.content_unified).where("next_id is not null").select("id", "next_id", F.round(seconds / 3600, 6).alias("hours"), D.closeness(seconds / 86400).alias("strength"))


@q("with d as (select source_type, created_at::date as day from content_unified where created_at is not null group by all), g as (select source_type, date_diff('day', lag(day) over (partition by source_type order by day), day) as gap from d) select source_type, round(avg(gap), 8) as mean_gap, min(gap) as least_gap, max(gap) as most_gap, 1 + count(*) filter (gap > 7) as n_clusters from g group by 1")
def win_gap_statistics(t):
    days = t.content_unified.where("created_at is not null").select("source_type", F.to_date("created_at").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("source_type").orderBy("day"))).cast("long")
    return days.withColumn("gap", gap).groupBy("source_type").agg(F.round(F.avg("gap"), 8).alias("mean_gap"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap"), (F.count_if(F.col("gap") > 7) + 1).alias("n_clusters"))


@q("with g as (select user_id, ts, case when date_diff('day', lag(ts::date) over w, ts::date) > 1 then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)), r as (select user_id, ts, 1 + sum(fresh) over (partition by user_id order by ts rows unbounded preceding)::bigint as run from g) select user_id, run, count(*) as n, min(ts) as first_at, max(ts) as last_at from r group by 1, 2")
def win_user_runs(t):
    return O.runs(t.events, "user_id", "ts", 1)


@q("with e as (select event_id, event_type, ts, row_number() over (partition by event_type order by ts desc, event_id) as place from events) select event_id, event_type, ts from e where place <= 10 order by ts desc, event_id limit 50")
def win_newest_per_type(t):
    return G.top_per(t.events, "event_type", [F.desc("ts"), F.col("event_id")], 10).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", "ts")


@q("with r as (select *, row_number() over (partition by content_id, model order by created_at desc nulls last, id desc) as k from content_embeddings where content_id is not null) select content_id, model, id, dim, created_at from r where k = 1")
def win_latest_embedding(t):
    rows = t.content_embeddings.where("content_id is not null").select("content_id", "model", "id", "dim", "created_at")
    order = [F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("id")]
    return O.latest(rows, ["content_id", "model"], order)


@q("with r as (select id, content_hash, row_number() over (partition by content_hash order by created_at, id) as k from emails where content_hash is not null) select id, content_hash from r where k > 1")
def win_later_copies(t):
    """Mails stored again: all but the oldest of each hash."""
    first = t.emails.where("content_hash is not null").groupBy("content_hash").agg(F.min_by("id", F.struct(F.coalesce("created_at", F.lit("9999-01-01").cast("timestamp_ntz")), "id")).alias("keep_id"))
    rows = t.emails.where("content_hash is not null").select("id", "content_hash").join(first, "content_hash")
    return rows.where("id <> keep_id").select("id", "content_hash")


@q("select matter_id, min(created_at) as first_at, max(created_at) as last_at, list(doc_type order by created_at, doc_id) as flow from documents where matter_id is not null and created_at is not null and doc_type = 'pleading' group by 1")
def win_document_flow(t):
    rows = t.documents.where("matter_id is not null and created_at is not null and doc_type = 'pleading'")
    flow = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "doc_id", "doc_type"))), lambda x: x["doc_type"])
    return rows.groupBy("matter_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), flow.alias("flow"))


@q("with d as (select distinct matter_id, created_at::date as day from documents where matter_id is not null and created_at is not null), g as (select matter_id, day, lead(day) over (partition by matter_id order by day) as next_day from d) select matter_id, day::varchar as day, next_day::varchar as next_day, date_diff('day', day, next_day) as gap, case when date_diff('day', day, next_day) > 120 then 'high' else 'medium' end as severity from g where date_diff('day', day, next_day) > 60")
def win_timeline_gaps(t):
    days = t.documents.where("matter_id is not null and created_at is not null").select("matter_id", F.to_date("created_at").alias("day")).distinct()
    g = days.withColumn("next_day", F.lead("day").over(Window.partitionBy("matter_id").orderBy("day"))).withColumn("gap", F.datediff("next_day", "day").cast("long"))
    return g.where("gap > 60").withColumn("day", F.col("day").cast("string")).withColumn("next_day", F.col("next_day").cast("string")).withColumn("severity", F.when(F.col("gap") > 120, "high").otherwise("medium"))


@q("select window_start, event_type, count(*) as n, round(sum(value), 4) as total from (select time_bucket(interval 1 hour, ts) as window_start, event_type, value from events) group by 1, 2")
def win_hourly_events(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


# --- Top rows and sets ---
@q("select normalized_form, entity_type, max(confidence) as confidence from email_entities where entity_type in ('PERSON', 'ORG') and normalized_form is not null group by 1, 2 order by confidence desc nulls last, normalized_form, entity_type limit 10")
def top_parties(t):
    g = t.email_entities.where("entity_type in ('PERSON', 'ORG') and normalized_form is not null").groupBy("normalized_form", "entity_type").agg(F.max("confidence").alias("confidence"))
    return g.orderBy(F.desc_nulls_last("confidence"), "normalized_form", "entity_type").limit(10)


@q("select thread_id, count(*) as n, max(datetime_utc) as last_at from emails where thread_id is not null group by 1 order by last_at desc nulls last, thread_id limit 100")
def top_recent_threads(t):
    return t.emails.where("thread_id is not null").groupBy("thread_id").agg(F.count("*").alias("n"), F.max("datetime_utc").alias("last_at")).orderBy(F.desc_nulls_last("last_at"), "thread_id").limit(100)


@q("select 'orphan' as side, content_id as id from (select content_id from content_embeddings where content_id is not null except select id from content_unified) union all select 'missing', id from (select id from content_unified except select content_id from content_embeddings)")
def set_vector_reconciliation(t):
    v = t.content_embeddings.where("content_id is not null").select(F.col("content_id").alias("id"))
    d = t.content_unified.select("id")
    return v.subtract(d).select(F.lit("orphan").alias("side"), "id").unionByName(d.subtract(v).select(F.lit("missing").alias("side"), "id"))


@q("select coalesce(a.model, 'none') as model, n_rows, n_contents from (select model, count(*) as n_rows from content_embeddings group by 1) a full outer join (select model, count(distinct content_id) as n_contents from content_embeddings group by 1) b on a.model = b.model")
def set_count_parity(t):
    a = t.content_embeddings.groupBy("model").agg(F.count("*").alias("n_rows"))
    b = t.content_embeddings.groupBy("model").agg(F.countDistinct("content_id").alias("n_contents"))
    return a.join(b, "model", "full_outer").select(F.coalesce("model", F.lit("none")).alias("model"), "n_rows", "n_contents")


@q("select message_id from emails union select message_id from email_entities")
def set_known_messages(t):
    return t.emails.select("message_id").union(t.email_entities.select("message_id")).distinct()


@q("select message_id from email_entities where entity_type = 'PERSON' intersect select message_id from email_entities where entity_type = 'ORG'")
def set_mails_with_both(t):
    e = t.email_entities
    return e.where("entity_type = 'PERSON'").select("message_id").intersect(e.where("entity_type = 'ORG'").select("message_id"))


_WS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda w: w <> ''))"


@q(f"select id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 8) as jaccard from (select id, {_WS.format('title')} as a, {_WS.format('body')} as b from content_unified)")
def set_word_overlap(t):
    return t.content_unified.select("id", F.round(X.word_jaccard("title", "body"), 8).alias("jaccard"))


QUERIES, ORACLE = book.queries, book.oracle
