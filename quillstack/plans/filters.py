"""Queries of filters, predicates and validation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillstack.functions import text as X
from quillstack.operators.filters import keyword_search, noise_of, payload_filter, structured_filter
from quillstack.plans.book import Book

book = Book()
q = book.query
SHOWN = ["id", "source_type", "title", "created_at"]


@q("""select id, source_type, title, created_at from content_unified where (contains(lower(coalesce(title, '')), 'lease') or contains(lower(coalesce(body, '')), 'lease'))
  and source_type in ('document', 'email_message') and created_at >= timestamp '2021-01-01' and created_at < timestamp '2025-01-01' order by created_at desc nulls last, id limit 50""")
def filter_keyword(t):
    return keyword_search(t.content_unified, ["lease"], ["document", "email_message"], datetime(2021, 1, 1), datetime(2025, 1, 1)).select(*SHOWN)


@q("""select id, source_type, title, created_at from content_unified where (contains(lower(coalesce(title, '')), 'motion') or contains(lower(coalesce(body, '')), 'motion'))
  and (contains(lower(coalesce(title, '')), 'ledger') or contains(lower(coalesce(body, '')), 'ledger') or contains(lower(coalesce(title, '')), 'survey') or contains(lower(coalesce(body, '')), 'survey'))
  order by created_at desc nulls last, id limit 50""")
def filter_keyword_any_tag(t):
    return keyword_search(t.content_unified, ["motion"], tags=["ledger", "survey"], every_tag=False).select(*SHOWN)


@q("""select id, source_type, title, created_at from content_unified where regexp_matches(lower(coalesce(title, '') || chr(1) || coalesce(body, '')), 'contract|agreement|lease')
  and source_type = 'document'""")
def filter_expanded_or(t):
    return keyword_search(t.content_unified, ["contract", "agreement", "lease"], ["document"], limit=None).select(*SHOWN)


@q("select chunk_id, chunk_index, source_type from document_chunks where source_type in ('upload', 'gmail_attachment') and chunk_index >= 0 and chunk_index < 3 and status = 'processed'")
def filter_payload(t):
    return t.document_chunks.where(payload_filter({"source_type": ["upload", "gmail_attachment"], "chunk_index": {"gte": 0, "lt": 3}, "status": "processed"})).select("chunk_id", "chunk_index", "source_type")


@q("""select chunk_id, extraction_method from document_chunks where chunk_index < 5 and (extraction_method = 'ocr' or extraction_method = 'docx') and not coalesce(status = 'failed', false)""")
def filter_structured(t):
    cond = structured_filter([{"chunk_index": {"lt": 5}}], [{"extraction_method": "ocr"}, {"extraction_method": "docx"}], [{"status": "failed"}])
    return t.document_chunks.where(cond).select("chunk_id", "extraction_method")


@q("""select id, message_id, datetime_utc from emails where contains(lower(coalesce(content, '')), 'inspection') or contains(lower(coalesce(subject, '')), 'inspection')
  order by datetime_utc desc nulls last, id limit 100""")
def filter_pattern_in_mail(t):
    return t.emails.where(X.any_has(["content", "subject"], ["inspection"])).orderBy(F.desc_nulls_last("datetime_utc"), "id").limit(100).select("id", "message_id", "datetime_utc")


@q("select id, entity_text, entity_type, confidence from email_entities where confidence >= 0.5 and entity_type in ('PERSON', 'ORG')")
def filter_entities(t):
    return t.email_entities.where((F.col("confidence") >= 0.5) & F.col("entity_type").isin("PERSON", "ORG")).select("id", "entity_text", "entity_type", "confidence")


@q("select id, length(content) as n_chars from emails where length(content) between 1 and 10000")
def filter_valid_length(t):
    return t.emails.where(F.length("content").between(1, 10000)).select("id", F.length("content").cast("long").alias("n_chars"))


@q("""select id from content_unified where length(trim(body)) > 20 and (length(body) - length(translate(body, '&=%', ''))) * 100 < 3 * length(body)""")
def filter_processable(t):
    body = F.col("body")
    return t.content_unified.where((F.length(F.trim(body)) > 20) & ((F.length(body) - F.length(F.translate(body, "&=%", ""))) * 100 < 3 * F.length(body))).select("id")


@q(r"""select id, case when length(trim(entity_text)) < 2 then 'short' when length(entity_text) > 100 then 'long' when regexp_matches(entity_text, '(?i)^(mon|tues|wednes|thurs|fri|satur|sun)day$') then 'weekday'
  when regexp_matches(entity_text, '</?[a-z]+|&[a-z]+;') then 'markup' when regexp_matches(entity_text, '[^\sA-Za-z0-9]{3,}') then 'symbols'
  when regexp_matches(entity_text, '(?i)(aaa|bbb|ccc|ddd|eee|iii|lll|mmm|nnn|ooo|rrr|sss|ttt|xxx|zzz)') then 'repeat' when regexp_matches(entity_text, '^[0-9 .,/-]+$') then 'figures'
  when regexp_matches(entity_text, '[\n\r\t]') then 'breaks' end as noise from email_entities""")
def filter_entity_noise(t):
    return t.email_entities.select("id", noise_of(F.col("entity_text")).alias("noise"))


@q(r"""select id, lower(trim(case when regexp_extract(sender, '<([^<>]+)>', 1) <> '' then regexp_extract(sender, '<([^<>]+)>', 1) else sender end)) as address from emails""")
def filter_header_address(t):
    return t.emails.select("id", X.header_address("sender").alias("address"))


@q(r"""select id, case when recipient_to is null or trim(recipient_to) = '' then 'empty' when length(recipient_to) > 320 then 'too long' when not contains(recipient_to, '@') then 'no at sign'
  when not regexp_matches(recipient_to, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') then 'malformed' end as fault from emails""")
def filter_address_fault(t):
    return t.emails.select("id", X.address_fault("recipient_to").alias("fault"))


@q("""select s, try_strptime(s, '%Y-%m-%dT%H:%M:%S') is not null or try_strptime(s, '%Y-%m-%d') is not null as valid from (values ('2024-01-05'), ('2024-13-05'), ('2024-01-05T10:11:12'), ('soon'), ('')) v(s)""")
def filter_iso_times(t):
    rows = t.spark.createDataFrame([("2024-01-05",), ("2024-13-05",), ("2024-01-05T10:11:12",), ("soon",), ("",)], "s string")
    valid = F.try_to_timestamp("s", F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull() | F.try_to_timestamp("s", F.lit("yyyy-MM-dd")).isNotNull()
    return rows.select("s", valid.alias("valid"))


@q("select count(*) as n, count(*) filter (datetime_utc <= created_at) as in_order, count(*) filter (datetime_utc > created_at) as reversed from emails")
def filter_date_range(t):
    a, b = F.col("datetime_utc"), F.col("created_at")
    return t.emails.agg(F.count(F.lit(1)).alias("n"), F.count_if(a <= b).alias("in_order"), F.count_if(a > b).alias("reversed"))


@q(r"""select id, left(trim(regexp_replace(subject, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')), 1000) as query from emails""")
def filter_sanitized_query(t):
    return t.emails.select("id", F.substring(F.trim(F.regexp_replace("subject", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")), 1, 1000).alias("query"))


@q(r"""select doc_id from documents where length(trim(text)) >= 10 and length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) * 10 <= 3 * length(text)""")
def filter_mostly_ascii(t):
    return t.documents.where((F.length(F.trim("text")) >= 10) & (F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")) * 10 <= 3 * F.length("text"))).select("doc_id")


@q(r"""select doc_id, length(left(text, 1000)) - length(regexp_replace(left(text, 1000), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) as n_control from documents where text is not null""")
def filter_control_characters(t):
    """Control characters in the first 1,000 characters, which is how the reference defines its check."""
    head = F.substring("text", 1, 1000)
    return t.documents.where("text is not null").select("doc_id", F.regexp_count(head, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).cast("long").alias("n_control"))


_AUTO = " or ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for c in ("subject", "sender", "content") for w in X.AUTOMATED)


@q(f"select id from emails where {_AUTO}")
def filter_automated_mail(t):
    return t.emails.where(X.is_automated("subject", "sender", "content")).select("id")


@q("select id, regexp_matches(lower(trim(coalesce(subject, ''))), '^(re|reply|response):') as reply from emails")
def filter_replies(t):
    return t.emails.select("id", X.is_reply("subject").alias("reply"))


@q("select chunk_id from document_chunks where regexp_matches(chunk_id, 'test_|tmp_|temp_|_test|_tmp') or regexp_matches(lower(file_name), 'motion')")
def filter_named_like(t):
    return t.document_chunks.where(F.col("chunk_id").rlike("test_|tmp_|temp_|_test|_tmp") | F.lower("file_name").rlike("motion")).select("chunk_id")


@q("select entity_type, norm as name, mentions from (select entity_type, normalized_form as norm, count(*) as mentions from email_entities where normalized_form is not null group by 1, 2) where entity_type = 'ORG' and contains(norm, 'law') order by mentions desc, name limit 100")
def filter_consolidated_entities(t):
    names = t.email_entities.where("normalized_form is not null").groupBy("entity_type", F.col("normalized_form").alias("name")).agg(F.count(F.lit(1)).alias("mentions"))
    return names.where((F.col("entity_type") == "ORG") & F.contains("name", F.lit("law"))).orderBy(F.desc("mentions"), "name").limit(100)


@q("select id from content_unified")
def scan_ids(t):
    return t.content_unified.select("id")


@q("select * from content_unified where id = 17")
def scan_point(t):
    return t.content_unified.where("id = 17")


@q("select id, title from content_unified where id in (1, 5, 9, 400, 999999)")
def scan_many(t):
    wanted = t.spark.createDataFrame([(i,) for i in (1, 5, 9, 400, 999999)], "id long")
    return t.content_unified.join(F.broadcast(wanted), "id", "left_semi").select("id", "title")


@q("select id from content_unified where source_type = 'transcript'")
def scan_type_ids(t):
    return t.content_unified.where("source_type = 'transcript'").select("id")


@q(r"""select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as n_lines, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\x00', '', 'g') as body from documents where text is not null""")
def scan_normalized_text(t):
    return t.documents.where("text is not null").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), X.few_breaks("text").alias("body"))


@q("select file_hash, round(avg(length(text_content)), 8) as mean_chars, avg(length(text_content)) < 1200 as scanned, round(1 - least(avg(length(text_content)) / 1000, 1), 8) as doubt from document_chunks where chunk_index < 5 group by file_hash")
def scan_scanned_files(t):
    mean = F.avg(F.length("text_content"))
    return t.document_chunks.where("chunk_index < 5").groupBy("file_hash").agg(F.round(mean, 8).alias("mean_chars"), (mean < 1200).alias("scanned"), F.round(1 - F.least(mean / 1000, F.lit(1.0)), 8).alias("doubt"))


@q(r"""select doc_id, regexp_extract_all(text, '\[([^\]]*)\]\(([^)]*)\)', 2) as urls, len(regexp_extract_all(text, '(?m)^#{1,6} +')) as n_headings, len(regexp_extract_all(text, '(?m)^[-*+] +')) as n_items from documents where text is not null""")
def scan_markdown_structure(t):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.documents.where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(r"\[([^\]]*)\]\(([^)]*)\)"), F.lit(2)).alias("urls"), count("(?m)^#{1,6} +").alias("n_headings"), count("(?m)^[-*+] +").alias("n_items"))


@q(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '(?m)^#{1,6} +', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`]{1,3}([^*_`]+)[*_`]{1,3}', '\1', 'g'), '(?m)^[-*+] +', '', 'g')) as plain from documents where text is not null""")
def scan_plain_markdown(t):
    return t.documents.where("text is not null").select("doc_id", X.without_markdown("text").alias("plain"))


QUERIES, ORACLE = book.queries, book.oracle
