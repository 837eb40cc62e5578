"""Queries of string, hash, date and identifier functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import dates as D
from quillstack.functions import text as X
from quillstack.plans.book import Book

book = Book()
q = book.query
_SQ = r"trim(regexp_replace({}, '[ \t\n\r\f]+', ' ', 'g'))"


@q(rf"select id, case when length(s) > 120 then left(s, 120) || '...' else s end as body from (select id, {_SQ.format('body')} as s from content_unified)")
def text_clean(t):
    return t.content_unified.select("id", X.clean_text("body", 120).alias("body"))


@q("select id, lower(split_part(sender, '@', 2)) as domain from emails")
def text_domain(t):
    return t.emails.select("id", X.mail_domain("sender").alias("domain"))


@q(rf"select id, sha256({_SQ.format('lower(content)')}) as h from emails")
def text_body_hash(t):
    return t.emails.select("id", X.body_hash("content").alias("h"))


@q("select id, sha256(concat_ws('|', coalesce(lower(subject), ''), coalesce(lower(sender), ''), coalesce(strftime(datetime_utc, '%Y-%m-%d'), ''), coalesce(content, ''))) as h from emails")
def text_content_hash(t):
    return t.emails.select("id", X.content_hash(F.lower("subject"), F.lower("sender"), F.date_format("datetime_utc", "yyyy-MM-dd"), F.col("content")).alias("h"))


@q(r"select id, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(content, ''), '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), lambda x: lower(x)))) as addresses from emails")
def text_addresses(t):
    return t.emails.select("id", X.addresses_in("content").alias("addresses"))


@q(r"select chunk_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(file_name)), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')) as slug from document_chunks where file_name is not null")
def text_slug(t):
    return t.document_chunks.where("file_name is not null").select("chunk_id", X.slug("file_name").alias("slug"))


@q(r"""select chunk_id, case when length(s) > 20 then left(s, 17) || '...' else s end as safe from (select chunk_id, regexp_replace(regexp_replace(file_path, '[<>:"/\\|?*]', '_', 'g'), '[ _]+', '_', 'g') as s from document_chunks)""")
def text_safe_filename(t):
    return t.document_chunks.select("chunk_id", X.safe_filename("file_path", 20).alias("safe"))


@q(r"select chunk_id, left(left(file_name, length(file_name) - length(ext)), 12 - length(ext)) || ext as short from (select chunk_id, file_name, regexp_extract(file_name, '(\.[A-Za-z0-9]{1,5})$', 1) as ext from document_chunks where file_name is not null)")
def text_short_filename(t):
    return t.document_chunks.where("file_name is not null").select("chunk_id", X.short_filename("file_name", 12).alias("short"))


@q("select id, left(md5(concat_ws('|', normalized_form, entity_type)), 12) as entity_id from email_entities where normalized_form is not null and entity_type is not null")
def text_entity_id(t):
    return t.email_entities.where("normalized_form is not null and entity_type is not null").select("id", X.short_id(F.col("normalized_form"), F.col("entity_type")).alias("entity_id"))


@q("select content_pair_hash, md5(least(trim(content_id_1), trim(content_id_2)) || '||' || greatest(trim(content_id_1), trim(content_id_2))) as key from similarity_cache where content_id_1 is not null and content_id_2 is not null")
def text_pair_key(t):
    rows = t.similarity_cache.where("content_id_1 is not null and content_id_2 is not null")
    return rows.select("content_pair_hash", X.pair_key(F.trim("content_id_1"), F.trim("content_id_2")).alias("key"))


@q(r"""select id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid
from (select id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source_type || ':' || source_id)) as h from content_unified where source_type is not null and source_id is not null)""")
def text_uuid(t):
    rows = t.content_unified.where("source_type is not null and source_id is not null")
    return rows.select("id", X.uuid5(F.concat_ws(":", "source_type", "source_id")).alias("uuid"))


@q(r"select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(entity_text), '\b(inc|incorporated|corp|corporation|llc|llp|pllc|ltd|limited|co|company)\b\.?', '', 'g'), '[^a-z0-9& ]+', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) as firm from email_entities where entity_type = 'ORG' and entity_text is not null")
def text_firm_key(t):
    return t.email_entities.where("entity_type = 'ORG' and entity_text is not null").select("id", X.firm_key("entity_text").alias("firm"))


@q(r"select doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '\b(\d{4}-[A-Z]{2}-\d{4,7})\b', 1))) as cases from documents")
def text_case_numbers(t):
    return t.documents.select("doc_id", X.case_numbers("text").alias("cases"))


@q(r"select doc_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<(br|/p|/div|/tr|/h[1-6])[^>]*>', chr(10), 'g'), '(?i)<li[^>]*>', '- ', 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) as plain from documents".replace('\\"', '"'))
def text_without_markup(t):
    return t.documents.select("doc_id", X.without_markup("text").alias("plain"))


@q(r"select doc_id, regexp_replace(trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g')), '\d+', '[NUM]', 'g') as k from documents")
def text_repeat_key(t):
    return t.documents.select("doc_id", X.text_key("text").alias("k"))


@q(r"""select doc_id, case when length(s) <= 150 then s else case when lo > 1 then '...' else '' end || trim(substr(s, lo, 150)) || case when lo + 149 < length(s) then '...' else '' end end as snippet
from (select doc_id, s, greatest(1, instr(lower(s), 'ledger') - 75) as lo from (select doc_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) as s from documents where contains(lower(text), 'ledger')))""")
def text_snippets(t):
    return t.documents.where(X.has("text", "ledger")).select("doc_id", X.snippet("text", "ledger").alias("snippet"))


@q(r"select doc_id, regexp_replace(text, '(?i)\b(motion)\b', '[\1]', 'g') as marked from documents where contains(lower(text), 'motion')")
def text_highlights(t):
    return t.documents.where(X.has("text", "motion")).select("doc_id", X.highlighted("text", "motion").alias("marked"))


@q("select extraction_method, chunk_id, case when ocr_confidence is null then 'unknown' when ocr_confidence >= 0.9 and word_count >= 50 then 'high' when ocr_confidence >= 0.75 then 'medium' else 'low' end as quality from document_chunks")
def text_ocr_quality(t):
    c = F.col("ocr_confidence")
    return t.document_chunks.select("extraction_method", "chunk_id", F.when(c.isNull(), "unknown").when((c >= 0.9) & (F.col("word_count") >= 50), "high").when(c >= 0.75, "medium").otherwise("low").alias("quality"))


@q("select event_id, json_extract_string(props, '$.k') as k from events")
def text_json_field(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@q(r"""select id, coalesce(try_strptime(nullif(regexp_extract(entity_text, '\b(\d{4}-\d{2}-\d{2})\b', 1), ''), '%Y-%m-%d')::date, try_strptime(nullif(regexp_extract(entity_text, '\b(\d{1,2}/\d{1,2}/\d{4})\b', 1), ''), '%-m/%-d/%Y')::date, try_strptime(nullif(regexp_extract(entity_text, '\b(\d{1,2}\.\d{1,2}\.\d{4})\b', 1), ''), '%-d.%-m.%Y')::date)::varchar as day from email_entities where entity_type = 'DATE'""")
def date_parsed(t):
    return t.email_entities.where("entity_type = 'DATE'").select("id", D.parsed_date(F.col("entity_text")).cast("string").alias("day"))


@q("select doc_id, case when contains(lower(text), 'filed') then 'filing' when contains(lower(text), 'hearing') then 'hearing' when contains(lower(text), 'served') then 'service' when contains(lower(text), 'due') or contains(lower(text), 'deadline') then 'deadline' else 'event' end as kind from documents where text is not null")
def date_kinds(t):
    return t.documents.where("text is not null").select("doc_id", D.date_kind(F.col("text")).alias("kind"))


@q("select id, round(coalesce(least(1.0, greatest(0.0, exp(-date_diff('day', created_at::date, date '2026-01-01') / 30.0))), 0.5), 8) as recency from content_unified")
def date_recency(t):
    return t.content_unified.select("id", F.round(D.recency(F.col("created_at")), 8).alias("recency"))


@q("select id from emails where datetime_utc >= timestamp '2025-12-01' and datetime_utc < timestamp '2026-01-01'")
def date_last_month(t):
    return t.emails.where((F.col("datetime_utc") >= F.lit(D.relative_date("last month"))) & (F.col("datetime_utc") < F.lit(D.relative_date("this month")))).select("id")


@q("select id from emails where datetime_utc >= timestamp '2025-12-02'")
def date_window(t):
    return t.emails.where(F.col("datetime_utc") >= F.lit(D.window_start("30d"))).select("id")


@q(r"select doc_id, regexp_extract_all(text, '\b((January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})\b', 1) as dates from documents where text is not null")
def date_mentions(t):
    p = r"\b((January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})\b"
    return t.documents.where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("dates"))


QUERIES, ORACLE = book.queries, book.oracle
