"""Queries of text mining, quality, boilerplate, entities, matters and threads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstack.functions import text as X
from quillstack.operators import quality as Q
from quillstack.operators import spans as S
from quillstack.operators import summaries as M
from quillstack.plans.book import Book

book = Book()
q = book.query


def docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


_STOP = ", ".join(f"'{w}'" for w in sorted(M.STOP))


@q(f"""with w as (select doc_id as id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as word from documents), tf as (select id, word, count(*) as tf from w where length(word) >= 3 and word not in ({_STOP}) group by 1, 2),
df as (select word, count(*) as df from tf group by 1), n as (select count(*) as n from documents), wt as (select id, word, tf * (ln((1.0 + n) / (1 + df)) + 1) as w from tf join df using (word), n where df <= n * 0.95),
sc as (select id, word, round(w / sqrt(sum(w * w) over (partition by id)), 9) as weight from wt), r as (select *, row_number() over (partition by id order by weight desc, word) as place from sc) select id, place, word, weight from r where place <= 10""")
def mine_keywords(t):
    return M.keywords(docs(t)).select("id", F.col("place").cast("long").alias("place"), "word", "weight")


@q()
def mine_summaries(t):
    return M.summaries(docs(t))


_QUAL = r"""m as (select doc_id, round(coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::double / nullif(length(text), 0), 0), 8) as letters, round(coalesce(length(regexp_replace(text, '[^0-9.,;:]', '', 'g'))::double / nullif(length(text), 0), 0), 8) as figures,
  round(coalesce(length(regexp_replace(text, '[A-Za-z0-9\s.,;:!?''\"()/$%&@-]', '', 'g'))::double / nullif(length(text), 0), 0), 8) as symbols, len(w)::bigint as n_words, round(coalesce(len(list_filter(w, lambda x: list_contains(['the', 'and', 'of', 'to', 'in', 'a', 'is', 'that', 'for', 'was', 'on', 'with', 'as', 'by', 'at', 'be', 'or', 'from', 'this', 'not'], x)))::double / nullif(len(w), 0), 0), 8) as common, length(text) as n_chars
  from (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') as w from documents)),
s as (select *, round(0.3 * least(1.0, letters / 0.8) + 0.2 * (1 - least(1.0, figures / 0.3)) + 0.2 * (1 - least(1.0, symbols / 0.05)) + 0.2 * least(1.0, common / 0.3) + 0.1 * least(1.0, n_chars / 500.0), 6) as score from m),
c as (select *, case when n_chars = 0 then 'EMPTY' when score >= 0.7 then 'PASS' when score >= 0.5 then 'BORDERLINE' else 'FAIL' end as status,
  array_to_string(list_sort(list_filter([case when letters < 0.6 then 'few_letters' end, case when figures > 0.3 then 'many_figures' end, case when symbols > 0.05 then 'many_symbols' end, case when n_words < 20 then 'few_words' end, case when n_chars < 200 then 'few_chars' end], lambda x: x is not null)), ',') as reasons from s)""".replace('\\"', '"')


@q("with " + _QUAL + " select doc_id, score, status, reasons from c")
def quality_scores(t):
    return Q.scored(t.documents.select("doc_id", "text")).select("doc_id", "score", "status", "reasons")


@q("with " + _QUAL + ", j as (select c.*, d.source from c join documents d using (doc_id)) select source, status, count(*) as n, round(avg(score), 5) as mean_score from j group by rollup (source, status)")
def quality_report(t):
    """Classes per source and overall in one pass."""
    rows = Q.scored(t.documents.select("doc_id", "source", "text"))
    return rows.rollup("source", "status").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


_P = r"select doc_id, unnest(string_split(text, chr(10) || chr(10))) as p from documents"


@q(f"""with p as ({_P}), k as (select doc_id, regexp_replace(trim(regexp_replace(lower(p), '[ \\t\\n\\r\\f]+', ' ', 'g')), '\\d+', '[NUM]', 'g') as passage from p where length(trim(p)) > 20), c as (select passage, count(distinct doc_id) as n_docs, count(*) as n from k group by 1), n as (select count(*) as total from documents)
select passage, n_docs, n, round(least(0.95, 0.5 + n_docs::double / total), 8) as confidence from c, n where n_docs >= 2 and n_docs >= total * 0.01""")
def boilerplate_repeated(t):
    return S.repeated_passages(docs(t))


@q()
def boilerplate_spans(t):
    return S.find_spans(docs(t), S.BOILERPLATE_PATTERNS)


@q()
def boilerplate_removed(t):
    return S.removed(docs(t), S.find_spans(docs(t), S.BOILERPLATE_PATTERNS))


@q("""with s as (select distinct message_id, start_char as a, end_char as b from email_entities where start_char is not null and end_char is not null), o as (select *, case when a > coalesce(max(b) over (partition by message_id order by a, b rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as fresh from s),
i as (select *, sum(fresh) over (partition by message_id order by a, b rows unbounded preceding) as island from o) select message_id as id, min(a) as start, max(b) as "end" from i group by message_id, island""")
def entity_merged_spans(t):
    rows = t.email_entities.where("start_char is not null and end_char is not null").select(F.col("message_id").alias("id"), F.col("start_char").alias("start"), F.col("end_char").alias("end")).distinct()
    return S.merged(rows)


@q()
def entity_spans(t):
    return S.without_overlaps(S.find_spans(docs(t), S.ENTITY_PATTERNS))


@q(r"select kind, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, 'money' as kind, unnest(regexp_extract_all(text, '\$\d{1,3}(?:,\d{3})*(?:\.\d\d)?')) from documents union all select doc_id, 'section', unnest(regexp_extract_all(text, '\bSec\. \d+(?:\.\d+)*(?:\(\d+\))?')) from documents union all select doc_id, 'case', unnest(regexp_extract_all(text, '\b\d{4}-[A-Z]{2}-\d{4,7}\b')) from documents) group by 1")
def entity_pattern_counts(t):
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, p in (("money", r"\$\d{1,3}(?:,\d{3})*(?:\.\d\d)?"), ("section", r"\bSec\. \d+(?:\.\d+)*(?:\(\d+\))?"), ("case", r"\b\d{4}-[A-Z]{2}-\d{4,7}\b"))]))
    rows = t.documents.select("doc_id", found.alias("f")).where("f.n > 0")
    return rows.groupBy("f.kind").agg(F.sum("f.n").alias("n"), F.count("*").alias("n_docs"))


@q("select lower(entity_text) as text, entity_type, max(confidence) as confidence, count(*) as mentions, count(distinct message_id) as n_mails, list_sort(list(distinct extractor_type)) as extractors from email_entities where entity_text is not null group by 1, 2")
def entity_consolidated(t):
    rows = t.email_entities.where("entity_text is not null")
    return rows.groupBy(F.lower("entity_text").alias("text"), "entity_type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("mentions"), F.countDistinct("message_id").alias("n_mails"), F.array_sort(F.collect_set("extractor_type")).alias("extractors"))


@q("select id, round(greatest(0.1, least(1.0, 0.8 + case when length(entity_text) > 20 then 0.1 when length(entity_text) < 4 then -0.2 else 0 end + case entity_type when 'PERSON' then 0.05 when 'DATE' then -0.05 else 0 end)), 8) as confidence from email_entities")
def entity_confidence(t):
    size, kind = F.length("entity_text"), F.col("entity_type")
    c = 0.8 + F.when(size > 20, 0.1).when(size < 4, -0.2).otherwise(0.0) + F.when(kind == "PERSON", 0.05).when(kind == "DATE", -0.05).otherwise(0.0)
    return t.email_entities.select("id", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), c)), 8).alias("confidence"))


@q("select message_id, list_sort(list(distinct normalized_form) filter (entity_type = 'PERSON')) as people, list_sort(list(distinct normalized_form) filter (entity_type = 'ORG')) as firms from email_entities where normalized_form is not null and entity_type in ('PERSON', 'ORG') group by 1 having count(distinct entity_type) = 2")
def entity_grouped_by_mail(t):
    rows = t.email_entities.where("normalized_form is not null and entity_type in ('PERSON', 'ORG')")
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("entity_type") == k, F.col("normalized_form"))))
    return rows.groupBy("message_id").agg(pick("PERSON").alias("people"), pick("ORG").alias("firms"), F.countDistinct("entity_type").alias("k")).where("k = 2").drop("k")


# --- Matters ---
_TYPES = ["complaint", "answer", "motion", "order", "judgment", "deposition", "discovery", "notice", "settlement"]
_HAS = ", ".join(f"bool_or(contains(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '{k}')) as has_{k}" for k in _TYPES)


def matter_types(t):
    """Kinds of document by words in the title or anywhere in the text."""
    head = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    rows = t.documents.where("matter_id is not null")
    return rows.groupBy("matter_id").agg(*[F.bool_or(F.contains(head, F.lit(k))).alias(f"has_{k}") for k in _TYPES])


@q(f"select matter_id, {_HAS} from documents where matter_id is not null group by 1")
def case_document_types(t):
    return matter_types(t)


@q(f"with h as (select matter_id, {_HAS} from documents where matter_id is not null group by 1) select matter_id, case when has_judgment then 'judgment' when has_motion then 'motion' when has_answer then 'answer' when has_complaint then 'complaint' else 'opening' end as stage from h")
def case_stage(t):
    stage = F.when(F.col("has_judgment"), "judgment").when(F.col("has_motion"), "motion").when(F.col("has_answer"), "answer").when(F.col("has_complaint"), "complaint").otherwise("opening")
    return matter_types(t).select("matter_id", stage.alias("stage"))


_SEQ = ["complaint", "answer", "discovery", "motion", "settlement", "judgment"]
_MISSING = " union all ".join(f"select matter_id, {i} as place, '{k}' as missing, least(1.0, {c} + case when has_notice then 0.2 else 0 end) as confidence from h where not has_{k}" for i, (k, c) in enumerate(zip(_SEQ, (0.8, 0.7, 0.6, 0.5, 0.5, 0.5))))


@q(f"with h as (select matter_id, {_HAS} from documents where matter_id is not null group by 1) {_MISSING}")
def case_missing_documents(t):
    """Expected kinds of document a matter lacks, by a literal sequence."""
    steps = F.explode(F.array(*[F.when(~F.col(f"has_{k}"), F.struct(F.lit(i).alias("place"), F.lit(k).alias("missing"), F.least(F.lit(1.0), F.lit(c) + F.when(F.col("has_notice"), 0.2).otherwise(0.0)).alias("confidence"))) for i, (k, c) in enumerate(zip(_SEQ, (0.8, 0.7, 0.6, 0.5, 0.5, 0.5)))]))
    return matter_types(t).select("matter_id", steps.alias("s")).where("s is not null").select("matter_id", "s.place", "s.missing", "s.confidence")


_THEMES = {"repairs": ["leak", "mold", "repair", "damage"], "payment": ["paid", "balance", "deposit"], "procedure": ["hearing", "motion", "deposition"], "possession": ["eviction", "keys", "lease"]}
_TH = ", ".join(f"round(avg(case when {' or '.join(f'''contains(lower(coalesce(text, '')), '{w}')''' for w in ws)} then 1.0 else 0.0 end), 8) as {k}" for k, ws in _THEMES.items())


@q(f"select matter_id, count(*) as n, {_TH} from documents where matter_id is not null group by 1")
def case_themes(t):
    return t.documents.where("matter_id is not null").groupBy("matter_id").agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(X.any_has(["text"], ws), 1.0).otherwise(0.0)), 8).alias(k) for k, ws in _THEMES.items()])


@q(r"select matter_id, other, count(*) as n from (select distinct doc_id, matter_id, unnest(regexp_extract_all(text, '\b(\d{4}-[A-Z]{2}-\d{4,7})\b', 1)) as other from documents where matter_id is not null) where other <> matter_id group by 1, 2 having count(*) >= 2")
def case_mentioned_together(t):
    rows = t.documents.where("matter_id is not null").select("matter_id", F.explode(X.case_numbers("text")).alias("other")).where("other <> matter_id")
    return rows.groupBy("matter_id", "other").agg(F.count("*").alias("n")).where("n >= 2")


@q(r"select doc_id, regexp_extract(title, '\b(\d{4}-[A-Z]{2}-\d{4,7})\b', 1) as case_no from documents where contains(upper(coalesce(text, '')), '2022-CA-000417') or matter_id = '2022-CA-000417'")
def case_documents(t):
    return t.documents.where(F.contains(F.upper(F.coalesce("text", F.lit(""))), F.lit("2022-CA-000417")) | (F.col("matter_id") == "2022-CA-000417")).select("doc_id", F.regexp_extract("title", r"\b(\d{4}-[A-Z]{2}-\d{4,7})\b", 1).alias("case_no"))


# --- Threads ---
@q(r"""select thread_id, count(*) as n, count(distinct sender) as n_senders, min(datetime_utc) as first_at, max(datetime_utc) as last_at, list_sort(list(distinct sender)) as senders from emails where thread_id is not null group by 1""")
def thread_summaries(t):
    return t.emails.where("thread_id is not null").groupBy("thread_id").agg(F.count("*").alias("n"), F.countDistinct("sender").alias("n_senders"), F.min("datetime_utc").alias("first_at"), F.max("datetime_utc").alias("last_at"), F.array_sort(F.collect_set("sender")).alias("senders"))


_WORDS = ["leak", "deposit", "hearing", "invoice"]


@q(" union all ".join(f"select '{w}' as keyword, id, thread_id from emails where contains(lower(coalesce(content, '')), '{w}')" for w in _WORDS))
def thread_disputed_topics(t):
    words = F.explode(F.filter(F.array(*[F.when(X.has("content", w), w) for w in _WORDS]), lambda w: w.isNotNull()))
    return t.emails.select(words.alias("keyword"), "id", "thread_id")


@q("select thread_id, sender, count(*) as n, count(*) filter (contains(lower(content), 'confirm') or contains(lower(content), 'agree')) as positive, count(*) filter (contains(lower(content), 'den') or contains(lower(content), 'dispute')) as negative from emails where thread_id is not null and content is not null group by 1, 2 having positive > 0 and negative > 0 and n > 1")
def thread_contradictions(t):
    pos, neg = X.any_has(["content"], ["confirm", "agree"]), X.any_has(["content"], ["den", "dispute"])
    g = t.emails.where("thread_id is not null and content is not null").groupBy("thread_id", "sender").agg(F.count("*").alias("n"), F.count_if(pos).alias("positive"), F.count_if(neg).alias("negative"))
    return g.where("positive > 0 and negative > 0 and n > 1")


@q(r"""select thread_id, id, row_number() over (partition by thread_id order by datetime_utc nulls first, id) as place,
array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '[.!?]+')[1:2], lambda x: trim(regexp_replace(x, '[ \t\n\r\f]+', ' ', 'g'))), lambda x: x <> ''), '. ') as opening from emails where thread_id is not null""")
def thread_narrative(t):
    """The first two sentences of every mail of a thread, in order of time."""
    w = Window.partitionBy("thread_id").orderBy(F.asc_nulls_first("datetime_utc"), "id")
    two = F.slice(F.split(F.coalesce("content", F.lit("")), "[.!?]+"), 1, 2)
    opening = F.array_join(F.filter(F.transform(two, lambda x: X.squeeze(x)), lambda x: x != ""), ". ")
    return t.emails.where("thread_id is not null").select("thread_id", "id", F.row_number().over(w).cast("long").alias("place"), opening.alias("opening"))


@q("select id, thread_id, case when contains(lower(content), 'denies') or contains(lower(content), 'dispute') then 'negative' when contains(lower(content), 'confirm') or contains(lower(content), 'admit') then 'affirmative' else 'neutral' end as position from emails where content is not null and contains(lower(content), 'leak')")
def thread_positions(t):
    c = F.when(X.any_has(["content"], ["denies", "dispute"]), "negative").when(X.any_has(["content"], ["confirm", "admit"]), "affirmative").otherwise("neutral")
    return t.emails.where(X.has("content", "leak")).select("id", "thread_id", c.alias("position"))


QUERIES, ORACLE = book.queries, book.oracle
