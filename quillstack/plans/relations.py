"""Queries of entity relations, names, timelines and sketches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstack.functions import text as X
from quillstack.operators import relations as R
from quillstack.plans.book import Book

book = Book()
q = book.query
_ADJ = r"""with mails as (select message_id, min(content) as content from emails where content is not null group by 1),
m as (select distinct message_id, entity_text as text, start_char as s, end_char as e, confidence as c from email_entities where entity_type in ('PERSON', 'ORG') and start_char is not null and end_char is not null),
p as (select *, lead(text) over w as target, lead(s) over w as ns, lead(c) over w as nc from m window w as (partition by message_id order by s, e, text, c)),
b as (select p.*, substr(content, (e + 1)::bigint, (ns - e)::bigint) as between from p join mails using (message_id) where ns - e between 0 and 100),
r as (select message_id, text as source, target, case when regexp_matches(between, '(?i)\b(represent|counsel for|on behalf of|attorney)') then 'represents' when regexp_matches(between, '(?i)\b(versus|v\.|against|sued)\b') then 'opposes' when regexp_matches(between, '(?i)\b(employ|works (for|at)|somebody from)\b') then 'employs'
  when regexp_matches(between, '(?i)\b(signed|both)\b') then 'signed_with' when regexp_matches(between, '(?i)\b(asked|told|wrote|called|met)\b') then 'communicates' else 'mentioned_with' end as relation, least(coalesce(c, 0.5), coalesce(nc, 0.5)) as base, ns - e as gap from b)"""


def mentions_and_mails(t):
    mails = t.emails.where("content is not null").groupBy("message_id").agg(F.min("content").alias("content"))
    m = t.email_entities.where("entity_type in ('PERSON', 'ORG')").select("message_id", F.col("entity_text").alias("text"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), "confidence").distinct()
    m = m.groupBy("message_id", "text", "start", "end").agg(F.max("confidence").alias("confidence"))
    return m, mails


def relations(t):
    return R.adjacent_relations(*mentions_and_mails(t))


@q(_ADJ.replace("confidence as c from email_entities", "max(confidence) as c from email_entities").replace("and end_char is not null)", "and end_char is not null group by all)").replace("order by s, e, text, c)", "order by s, e, text)").replace("select distinct message_id, entity_text", "select message_id, entity_text") + " select source, target, relation, max(round(greatest(0.1, least(1.0, base - least(0.2, gap / 500.0) + case when relation <> 'mentioned_with' then 0.1 else 0 end)), 6)) as confidence, count(*) as n from r group by 1, 2, 3")
def relation_best(t):
    return R.best_relations(relations(t))


@q(r"""with mails as (select message_id, min(content) as content from emails where content is not null group by 1),
m as (select message_id, entity_text as text, start_char as s, end_char as e, max(confidence) as c from email_entities where entity_type in ('PERSON', 'ORG') and start_char is not null and end_char is not null group by all),
b as (select a.text as source, z.text as target, least(coalesce(a.c, 0.5), coalesce(z.c, 0.5)) as base, greatest(0, z.s - a.e) as gap, substr(content, (a.e + 1)::bigint, greatest(0, z.s - a.e)::bigint) as between
  from m a join m z on a.message_id = z.message_id and (z.s > a.s or z.s = a.s and (z.e > a.e or z.e = a.e and z.text > a.text)) and z.s - a.e <= 100 join mails on mails.message_id = a.message_id),
r as (select *, case when regexp_matches(between, '(?i)\b(represent|counsel for|on behalf of|attorney)') then 'represents' when regexp_matches(between, '(?i)\b(versus|v\.|against|sued)\b') then 'opposes' when regexp_matches(between, '(?i)\b(employ|works (for|at)|somebody from)\b') then 'employs'
  when regexp_matches(between, '(?i)\b(signed|both)\b') then 'signed_with' when regexp_matches(between, '(?i)\b(asked|told|wrote|called|met)\b') then 'communicates' else 'mentioned_with' end as relation from b)
select source, target, relation, max(round(greatest(0.1, least(1.0, base - least(0.2, gap / 500.0) + case when relation <> 'mentioned_with' then 0.1 else 0 end)), 6)) as confidence, count(*) as n from r group by 1, 2, 3""")
def relation_near(t):
    """Every pair of mentions of a mail within 100 characters; ``relation_best`` has the next mention only."""
    return R.best_relations(R.near_relations(*mentions_and_mails(t)))


@q(r"""with s as (select id, trim(regexp_replace(entity_text, '(?i),? (esq|jr|sr)\.?$', '')) as s from email_entities where entity_type = 'PERSON' and entity_text is not null),
p as (select id, case when contains(s, ',') then trim(split_part(s, ',', 1)) else regexp_extract(s, '([^ ]+)$', 1) end as surname, trim(case when contains(s, ',') then split_part(s, ',', 2) else regexp_extract(s, '^(.*) [^ ]+$', 1) end) as rest from s)
select id, lower(regexp_extract(rest, '^([^ .]+)', 1)) as given, regexp_replace(regexp_extract(rest, '((?:[A-Z]\. ?)+)$', 1), '[ .]', '', 'g') as initials, lower(surname) as surname from p""")
def relation_name_parts(t):
    rows = t.email_entities.where("entity_type = 'PERSON' and entity_text is not null")
    return rows.select("id", *[c.alias(k) for k, c in R.name_parts("entity_text").items()])


@q()
def relation_spelling_ratio(t):
    """Spellings against the rough form stored with them."""
    rows = t.email_entities.where("normalized_form is not null and entity_text is not null").select(F.lower("entity_text").alias("text"), "normalized_form").distinct()
    return rows.withColumn("ratio", F.round(R.spelling_ratio("text", "normalized_form"), 6))


@q()
def cluster_ward(t):
    return R.ward_clusters(t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), "label", 1.2)


_CONCEPTS = ["negligence", "breach of contract", "retaliation", "constructive eviction", "unjust enrichment", "promissory estoppel", "conversion", "nuisance"]


@q(" union all ".join(f"select '{c}' as concept, doc_id, len(regexp_extract_all(lower(text), '\\b{c}\\b')) as n from documents where regexp_matches(lower(text), '\\b{c}\\b')" for c in _CONCEPTS))
def relation_concepts(t):
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.regexp_count(F.lower("text"), F.lit(rf"\b{c}\b")).cast("long").alias("n")) for c in _CONCEPTS]))
    return t.documents.where("text is not null").select("doc_id", each.alias("c")).where("c.n > 0").select("c.concept", "doc_id", "c.n")


# --- Timelines ---
@q("select event_id, event_type, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and event_type = 'purchase' order by ts desc, event_id limit 50")
def timeline_events(t):
    rows = t.events.where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-20' and event_type = 'purchase'")
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", "ts")


_TL = "tl as (select 'email' as kind, message_id as ref, coalesce(nullif(trim(subject), ''), 'No subject') as title, datetime_utc as ts from emails union all select 'document', chunk_id, coalesce(file_name, 'Unnamed'), processed_at from document_chunks where chunk_index = 0 union all select 'content', id::varchar, coalesce(title, 'Untitled'), created_at from content_unified)"


def timeline(t):
    mails = t.emails.select(F.lit("email").alias("kind"), F.col("message_id").alias("ref"), F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.lit("No subject")).alias("title"), F.col("datetime_utc").alias("ts"))
    docs = t.document_chunks.where("chunk_index = 0").select(F.lit("document").alias("kind"), F.col("chunk_id").alias("ref"), F.coalesce("file_name", F.lit("Unnamed")).alias("title"), F.col("processed_at").alias("ts"))
    content = t.content_unified.select(F.lit("content").alias("kind"), F.col("id").cast("string").alias("ref"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.col("created_at").alias("ts"))
    return mails.unionByName(docs).unionByName(content)


@q(f"with {_TL} select left(md5(concat_ws('|', kind, ref)), 12) as event_id, kind, title, ts from tl where ref is not null")
def timeline_synced(t):
    return timeline(t).where("ref is not null").select(X.short_id(F.col("kind"), F.col("ref")).alias("event_id"), "kind", "title", "ts")


@q(f"with {_TL} select kind, strftime(ts, '%Y-%m-%d') as day, count(*) as n, min(title) as first_title from tl where ts is not null group by 1, 2")
def timeline_days(t):
    return timeline(t).where("ts is not null").groupBy("kind", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


@q(f"with {_TL} select kind, count(*) as n, count(ts) as n_dated, min(ts) as first_at, max(ts) as last_at from tl group by 1")
def timeline_statistics(t):
    return timeline(t).groupBy("kind").agg(F.count("*").alias("n"), F.count("ts").alias("n_dated"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@q("with c as (select id, created_at as ts from content_unified where created_at is not null), p as (select id as pid, ts as pts from c where id = (select min(id) from c where id >= 50)), b as (select id, ts, 'before' as side, row_number() over (order by ts desc, id desc) as k from c, p where (ts, id) < (pts, pid)), a as (select id, ts, 'after' as side, row_number() over (order by ts, id) as k from c, p where (ts, id) > (pts, pid)) select side, k as place, id, ts from (select * from b union all select * from a) where k <= 5")
def timeline_context(t):
    """Five items before and after one item: two top-k searches, so nothing is sorted as a whole."""
    c = t.content_unified.where("created_at is not null").select("id", F.col("created_at").alias("ts"))
    one = F.broadcast(c.where("id >= 50").agg(F.min_by(F.struct("ts", "id"), "id").alias("p")))
    near = c.crossJoin(one)
    me = F.struct("ts", "id")
    before = near.where(me < F.col("p")).orderBy(F.desc("ts"), F.desc("id")).limit(5).withColumn("side", F.lit("before")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("id"))).cast("long"))
    after = near.where(me > F.col("p")).orderBy("ts", "id").limit(5).withColumn("side", F.lit("after")).withColumn("place", F.row_number().over(Window.orderBy("ts", "id")).cast("long"))
    return before.unionByName(after).select("side", "place", "id", "ts")


@q("select doc_id, strftime(created_at, '%Y') as year, case when contains(lower(coalesce(title, '')), 'motion') then 'filing' when contains(lower(coalesce(title, '')), 'deposition') then 'hearing' when contains(lower(coalesce(title, '')), 'order') then 'judgment' end as milestone from documents where regexp_matches(lower(coalesce(title, '')), 'motion|deposition|order')")
def timeline_milestones(t):
    kind = F.when(X.has("title", "motion"), "filing").when(X.has("title", "deposition"), "hearing").when(X.has("title", "order"), "judgment")
    return t.documents.where(kind.isNotNull()).select("doc_id", F.date_format("created_at", "yyyy").alias("year"), kind.alias("milestone"))


# --- Sketches ---
_SEEDS = [(1103515245, 12345), (69069, 1234567), (1664525, 1013904223), (22695477, 1)]
_H = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(body, '')), '[^a-z0-9]+'), lambda w: w <> ''))"
_MIN = ", ".join(f"list_min(list_transform(hs, lambda h: (h * {a} + {b}) % 4294967311)) as m{k}" for k, (a, b) in enumerate(_SEEDS))


@q(f"with w as (select id, list_transform({_H}, lambda w: ('0x' || left(md5(w), 8))::bigint) as hs from content_unified) select id, {_MIN} from w where len(hs) > 0")
def copies_signatures(t):
    """Minima of four hash families over the words of a body: an estimate of their overlap, as plain expressions."""
    hs = F.transform(X.word_set("body"), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    rows = t.content_unified.select("id", hs.alias("hs")).where("size(hs) > 0")

    def least(a: int, b: int):
        return F.array_min(F.transform("hs", lambda h: (h * a + b) % 4294967311))

    return rows.select("id", *[least(a, b).alias(f"m{k}") for k, (a, b) in enumerate(_SEEDS)])


@q("with m as (select thread_id, id, content, lag(content) over (partition by thread_id order by datetime_utc, id) as before from emails where thread_id is not null and content is not null), s as (select thread_id, id, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda w: w <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(before), '[^a-z0-9]+'), lambda w: w <> '')) as b from m where before is not null) select thread_id, id, round(coalesce(len(list_intersect(a, b))::double / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 8) as jaccard from s")
def copies_in_threads(t):
    """Each mail against the one before it in its thread."""
    w = Window.partitionBy("thread_id").orderBy(F.asc_nulls_last("datetime_utc"), "id")
    m = t.emails.where("thread_id is not null and content is not null").withColumn("before", F.lag("content").over(w)).where("before is not null")
    return m.select("thread_id", "id", F.round(X.word_jaccard("content", "before"), 8).alias("jaccard"))


QUERIES, ORACLE = book.queries, book.oracle
