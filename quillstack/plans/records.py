"""Queries on file names, chunks, states, evidence, markup, gates of quality and stored clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstack.functions import names as N
from quillstack.functions import text as X
from quillstack.operators import copies as C
from quillstack.operators import encode as E
from quillstack.operators import graph as G
from quillstack.operators import mail as M
from quillstack.operators import quality as Q
from quillstack.operators import vectors as V
from quillstack.operators import windows as W
from quillstack.plans.book import Book
from quillstack.sources import files as L

book = Book()
q = book.query


def files(t):
    return t.document_chunks.where("file_name is not null").select("file_name", "file_path").distinct()


_NAME_DATES = [(r"(\d{4})-(\d{2})-(\d{2})", "1,2,3"), (r"(\d{4})_(\d{2})_(\d{2})", "1,2,3"), (r"(\d{4})(\d{2})(\d{2})", "1,2,3"), (r"(\d{2})-(\d{2})-(\d{4})", "3,1,2"), (r"(\d{2})_(\d{2})_(\d{4})", "3,1,2"), (r"(\d{2})/(\d{2})/(\d{4})", "3,1,2")]
_ISO = ["case when regexp_matches({c}, '{p}') then try_cast(concat_ws('-', {g}) as date) end".format(c="{c}", p=p.replace("{", "{{").replace("}", "}}"), g=", ".join(f"regexp_extract({{c}}, '{p.replace('{', '{{').replace('}', '}}')}', {k})" for k in g.split(","))) for p, g in _NAME_DATES]


def _name_date_sql(c: str) -> str:
    each = [f"case when year({x}) between 1900 and 2100 then {x} end" for x in (i.format(c=c) for i in _ISO)]
    return f"coalesce({', '.join(each)})"


@q(f"""with n as (select distinct file_name from document_chunks where file_name is not null union select 'scan_20240229.pdf' union select 'a 02-30-2023 b' union select '12_31_1999_x' union select '2021-05-06_notice.md' union select '18991231')
select file_name, ({_name_date_sql('file_name')})::varchar as dated, (case when regexp_matches(file_name, '^\\d{{4}}-\\d{{2}}-\\d{{2}}_') then try_cast(left(file_name, 10) as date) end)::varchar as prefix_date from n""")
def file_dates(t):
    """Dates in file names by six patterns in order, and the date a name begins with; impossible dates and years outside 1900-2100 are passed over."""
    more = t.spark.createDataFrame([("scan_20240229.pdf",), ("a 02-30-2023 b",), ("12_31_1999_x",), ("2021-05-06_notice.md",), ("18991231",)], "file_name string")
    return files(t).select("file_name").unionByName(more).distinct().select("file_name", N.date_in_name("file_name").cast("string").alias("dated"), N.date_prefix("file_name").cast("string").alias("prefix_date"))


@q(r"""with s as (select distinct file_name, list_sort(list_distinct(string_split(lower(regexp_replace(file_name, '\.[^.]*$', '')), ''))) as chars from document_chunks where file_name is not null), o as (select chars as own from s order by file_name limit 1)
select file_name, round(len(list_intersect(chars, own))::double / len(list_distinct(list_concat(chars, own))), 8) as similarity from s, o where len(list_intersect(chars, own))::double / len(list_distinct(list_concat(chars, own))) >= 0.8""")
def file_similar_names(t):
    """Files whose stem has nearly the characters of a given one's: here the first name in order."""
    rows = files(t).select("file_name", N.stem_characters("file_name").alias("chars")).distinct()
    one = rows.agg(F.min_by("chars", "file_name").alias("own"))
    share = F.size(F.array_intersect("chars", "own")) / F.size(F.array_union("chars", "own"))
    return rows.join(F.broadcast(one)).withColumn("share", share).where("share >= 0.8").select("file_name", F.round("share", 8).alias("similarity"))


_CHECK = ["report.pdf", "", "con.txt", "a<b>.md", "trailing. ", "x" * 300, "a/b", ".hidden", "LPT1", "two  words.doc"]


@q("with n(file_name) as (values " + ", ".join("('" + c + "')" for c in _CHECK) + """), e as (select file_name, list_filter([case when file_name = '' then 'empty' end, case when regexp_matches(file_name, '[<>:"/\\\\|?*]') then 'reserved_character' end,
case when regexp_matches(upper(regexp_extract(file_name, '^[^.]*')), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') then 'reserved_name' end, case when regexp_matches(file_name, '[. ]$') then 'ends_badly' end, case when length(file_name) > 255 then 'too_long' end], lambda x: x is not null) as errors from n)
select file_name, array_to_string(errors, ',') as errors, len(errors) = 0 as valid from e""")
def file_name_faults(t):
    rows = t.spark.createDataFrame([(c,) for c in _CHECK], "file_name string")
    return rows.select("file_name", F.array_join(N.name_faults("file_name"), ",").alias("errors"), (F.size(N.name_faults("file_name")) == 0).alias("valid"))


@q("select file_path, string_agg(text_content, ' ' order by chunk_index) as body, count(*) as n_chunks, sum(length(text_content))::bigint as n_chars from (select distinct file_path, chunk_index, text_content from document_chunks where text_content is not null) group by 1")
def chunk_full_texts(t):
    """The text of every file put together from its chunks."""
    rows = t.document_chunks.where("text_content is not null").select("file_path", "chunk_index", "text_content").distinct()
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text_content")))
    return rows.groupBy("file_path").agg(F.array_join(F.transform(parts, lambda x: x["text_content"]), " ").alias("body"), F.count("*").alias("n_chunks"), F.sum(F.length("text_content")).alias("n_chars"))


@q("select chunk_id, file_name, attempt_count, error_message from document_chunks where status = 'failed' or attempt_count > 0 order by attempt_count desc, chunk_id, file_name, error_message limit 5")
def top_failing_chunks(t):
    return t.document_chunks.where("status = 'failed' or attempt_count > 0").orderBy(F.desc("attempt_count"), "chunk_id", "file_name", F.asc_nulls_last("error_message")).limit(5).select("chunk_id", "file_name", "attempt_count", "error_message")


@q(r"""with s as (select trim(regexp_replace(lower(coalesce(subject, '')), '^((re|fwd|fw)\s*:\s*)+', '')) as topic, min(datetime_utc) as first_at, count(*) as n from emails where datetime_utc is not null group by 1)
select topic, first_at, n, dense_rank() over (order by first_at, topic) as thread_no from s""")
def win_numbered_threads(t):
    """Threads by subject, numbered by their first appearance."""
    topic = F.trim(F.regexp_replace(F.lower(F.coalesce("subject", F.lit(""))), r"^((re|fwd|fw)\s*:\s*)+", ""))
    firsts = t.emails.where("datetime_utc is not null").groupBy(topic.alias("topic")).agg(F.min("datetime_utc").alias("first_at"), F.count("*").alias("n"))
    return W.ranked_in_time(firsts, "first_at", ["topic"], "thread_no")


_LAG = "abs(epoch(n_at) - epoch(a_at)) < 86400"


@q(f"""with r as (select id, created_at as a_at, lead(id) over w as next_id, lead(created_at) over w as n_at from content_unified where created_at is not null window w as (order by created_at, id))
select id, next_id, case when {_LAG} then 'concurrent' when n_at > a_at then 'followed_by' else 'preceded_by' end as relation from r where next_id is not null""")
def timeline_relation_kinds(t):
    """How each item relates in time to the next: within a day, or followed by it."""
    rows = W.following(t.content_unified).where("next_id is not null")
    apart = F.abs(F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) < 86_400_000_000
    return rows.select("id", "next_id", F.when(apart, "concurrent").when(F.col("next_at") > F.col("at"), "followed_by").otherwise("preceded_by").alias("relation"))


_TERMS = ["leak", "roof", "deposit"]
_POS = " + ".join(f"case when contains(lower(s), '{w}') then (1.0 - (strpos(lower(s), '{w}') - 1)::double / length(s)) * 0.1 else 0 end" for w in _TERMS)
_HIT = " + ".join(f"case when list_contains(regexp_split_to_array(trim(lower(s), chr(10) || chr(13) || chr(9) || ' '), '[ \\t\\n\\r\\f]+'), '{w}') then 1 else 0 end" for w in _TERMS)


@q(f"with d as (select doc_id, left(text, 300) as s from documents where contains(lower(text), 'leak')) select doc_id, round(({_HIT})::double / 3 * (1.0 + {_POS}) * least(1.0, 200.0 / length(s)), 8) as score from d")
def search_snippet_scores(t):
    """Score of a snippet: share of the terms, earlier ones worth more, long ones less."""
    rows = t.documents.where(F.contains(F.lower("text"), F.lit("leak"))).select("doc_id", F.substring("text", 1, 300).alias("s"))
    return rows.select("doc_id", F.round(N.snippet_score("s", _TERMS), 8).alias("score"))


@q("""with o as (select 'status' as key, status as value, processed_at as put_at, chunk_id from document_chunks union all select 'method', extraction_method, processed_at, chunk_id from document_chunks)
select key, value from (select *, row_number() over (partition by key order by put_at desc nulls last, chunk_id desc, value desc nulls last) as k from o) where k = 1""")
def sink_latest_settings(t):
    """Key-value state, the last written value wins."""
    rows = t.document_chunks.select(F.explode(F.array(F.struct(F.lit("status").alias("key"), F.col("status").alias("value")), F.struct(F.lit("method").alias("key"), F.col("extraction_method").alias("value")))).alias("s"), F.col("processed_at").alias("at"), "chunk_id").select("s.*", "at", "chunk_id")
    return rows.groupBy("key").agg(F.max_by("value", F.struct("at", "chunk_id", "value")).alias("value"))


@q("""with u as (select split_part(sender, '@', 2) as account, max(message_id) filter (datetime_utc < timestamp '2023-01-01') as old_cursor, max(message_id) filter (datetime_utc >= timestamp '2023-01-01') as new_cursor, count(*) filter (datetime_utc < timestamp '2023-01-01') as old_n, count(*) filter (datetime_utc >= timestamp '2023-01-01') as new_n from emails where sender is not null group by 1)
select account, coalesce(new_cursor, old_cursor) as cursor, old_n + new_n as processed from u""")
def sink_sync_state(t):
    """State per account: a new cursor replaces the old one where there is one, counters add up."""
    early = F.col("datetime_utc") < F.lit("2023-01-01").cast("timestamp_ntz")
    rows = t.emails.where("sender is not null").groupBy(F.split_part("sender", F.lit("@"), F.lit(2)).alias("account"))
    state = rows.agg(F.max(F.when(early, F.col("message_id"))).alias("old"), F.max(F.when(~early, F.col("message_id"))).alias("new"), F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    return state.select("account", F.coalesce("new", "old").alias("cursor"), (F.col("a") + F.col("b")).alias("processed"))


@q("""select chunk_id, case when extraction_method = 'ocr' then 'combined' else extraction_method end as summary_type, coalesce(ocr_confidence, 0.0) as confidence,
array_to_string(list_filter([case when extraction_method <> 'ocr' then 'unknown_type' end, case when coalesce(ocr_confidence, 0.0) not between 0 and 1 then 'confidence' end, case when text_content is null then 'no_text' end], lambda x: x is not null), ',') as refused from document_chunks""")
def sink_checked_summaries(t):
    """Rows to be stored as summaries with the checks they fail: kind of summary, confidence in 0..1, text."""
    kind, sure = F.when(F.col("extraction_method") == "ocr", "combined").otherwise(F.col("extraction_method")), F.coalesce("ocr_confidence", F.lit(0.0))
    rows = t.document_chunks.select("chunk_id", kind.alias("summary_type"), sure.alias("confidence"), "text_content")
    faults = F.filter(F.array(F.when(~F.col("summary_type").isin("tfidf", "textrank", "combined"), "unknown_type"), F.when(~F.col("confidence").between(0, 1), "confidence"), F.when(F.col("text_content").isNull(), "no_text")), lambda x: x.isNotNull())
    return rows.select("chunk_id", "summary_type", "confidence", F.array_join(faults, ",").alias("refused"))


_LAWS = ["15  u.s.c.  1692", "42 USC 1983", "24 cfr 982", "  28 U.S.C 1331 ", "no law"]


@q("with l(s) as (values " + ", ".join("('" + x + "')" for x in _LAWS) + r") select s as citation, regexp_replace(regexp_replace(regexp_replace(trim(s), '\s+', ' ', 'g'), 'u\.?s\.?c\.?', 'USC', 'gi'), 'cfr', 'CFR', 'gi') as normal from l")
def text_statute_key(t):
    return t.spark.createDataFrame([(x,) for x in _LAWS], "citation string").select("citation", N.statute_key("citation").alias("normal"))


@q("""with f as (select label, doc_id from (select e.label, d.doc_id, row_number() over (partition by e.label order by e.vec_id) as k from embeddings e join documents d on d.doc_id = e.vec_id) where k <= 10),
w as (select f.label, unnest(regexp_extract_all(d.text, '\\b[A-Z][a-z]{3,}\\b')) as word from f join documents d using (doc_id)), c as (select label, word, count(*) as n from w group by 1, 2), r as (select *, row_number() over (partition by label order by n desc, word) as k from c)
select label, string_agg(word, ', ' order by k) as title from r where k <= 3 group by 1""")
def cluster_titles(t):
    """Clusters titled by the three commonest capitalised words of their first ten documents."""
    few = G.top_per(t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id"), "label", [F.col("vec_id")], 10)
    words = few.select("label", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0))).alias("word")).groupBy("label", "word").agg(F.count("*").alias("n"))
    best = G.top_per(words, "label", [F.desc("n"), F.col("word")], 3)
    return best.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), ", ").alias("title"))


@q("select m.head as src, e.vec_id as dst, 'same_cluster' as relation, 0.7 as strength from embeddings e join (select label, min(vec_id) as head from embeddings group by 1) m using (label) where e.vec_id <> m.head")
def cluster_edges(t):
    """Members of stored clusters linked to the cluster's first member: the pairs of a cluster follow from these."""
    heads = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("src"))
    rows = G.many_to_one(t.embeddings.select("label", F.col("vec_id").alias("dst")), heads, "label").where("dst <> src")
    return rows.select("src", "dst", F.lit("same_cluster").alias("relation"), F.lit(0.7).alias("strength"))


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::double * x[2]::double))"


@q(f"""with s as (select label, vec, vec_id from (select label, embedding as vec, vec_id, row_number() over (partition by label order by vec_id) as k from embeddings where vec_id % 10 <> 0) where k <= 10), n as (select vec_id, embedding as vec from embeddings where vec_id % 10 = 0),
m as (select n.vec_id, s.label, avg({_DOT('n.vec', 's.vec')} / (sqrt({_DOT('n.vec', 'n.vec')}) * sqrt({_DOT('s.vec', 's.vec')}))) as sim from n, s group by 1, 2), b as (select vec_id, max(sim) as sim, arg_max(label, (round(sim, 10), -label)) as label from m group by 1)
select vec_id as id, case when sim > 0.6 then label end as cluster, round(sim, 6) as sim from b""")
def cluster_assigned(t):
    """New items put into the cluster whose first ten members are most alike on average, if that is more than 0.6."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return V.assigned(v.where("id % 10 = 0").select("id", "vector"), v.where("id % 10 <> 0"), members=10, least=0.6).select("id", "cluster", F.round("sim", 6).alias("sim"))


@q(r"""with w as (select doc_id, text, lower(text) as low, string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), '') as cs, length(text)::double as n from documents where length(trim(text)) > 0),
m as (select doc_id, n::bigint as n_chars, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / n as alpha, length(regexp_replace(text, '[^0-9.,;:!?()\[\]{}"''-]', '', 'g')) / n as noise, length(regexp_replace(text, '[^&=%£€<>©#@$*+^~|\\]', '', 'g')) / n as symbols,
 len(list_distinct(list_filter(list_transform(list_zip(cs[:-2], cs[2:]), lambda p: p[1] || p[2]), lambda b: regexp_matches(b, '^[a-z][a-z]$')))) as bigrams, regexp_extract_all(low, '[a-z0-9_]+') as ws from w),
s as (select *, case when len(ws) = 0 then 0.0 else len(list_filter(ws, lambda x: list_contains(['the', 'and', 'of', 'to', 'in', 'a', 'is', 'that', 'for', 'was', 'on', 'with', 'as', 'by', 'at', 'be', 'or', 'from', 'this', 'not'], x)))::double / len(ws) end as hits from m)
select doc_id, n_chars, bigrams::bigint as bigrams, round(0.25 * least(alpha / 0.55, 1.0) + 0.15 * greatest(0.0, 1 - noise / 0.35) + 0.15 * greatest(0.0, 1 - symbols / 0.15) + 0.15 * least(bigrams / 200.0, 1.0) + 0.2 * least(hits / 0.35, 1.0) + 0.1 * least(n_chars / 300.0, 1.0), 3) as score,
 array_to_string(list_filter([case when n_chars < 1500 and n_chars < 300 then 'insufficient_content' end, case when alpha < 0.55 then 'low_alpha_ratio' end, case when noise > 0.35 then 'high_noise_ratio' end, case when symbols > 0.15 then 'high_symbol_ratio' end, case when bigrams < 200 then 'low_bigram_diversity' end, case when hits < 0.35 then 'low_english_hits' end], lambda x: x is not null), ',') as reasons from s""")
def quality_gates(t):
    """Six gates, distinct pairs of letters, share of dictionary words and the weighted score. The dictionary is a parameter; here the commonest words."""
    return Q.gated(t.documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text")).select("doc_id", "n_chars", "bigrams", "score", "reasons")


@q(r"""with e as (select least(a, b) as s, greatest(a, b) as d from (select try_cast(trim(content_id_1) as bigint) as a, try_cast(trim(content_id_2) as bigint) as b from similarity_cache where similarity_score >= 0.7) where a <> b group by 1, 2)
select n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1) / 2.0), 10) as density from (select count(*) as n_edges from e), (select count(distinct x) as n_nodes from (select s as x from e union all select d from e))""")
def graph_density(t):
    edges = G.similarity_edges(t.similarity_cache)
    sizes = edges.agg(F.count("*").alias("n_edges")).join(edges.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("n_nodes")))
    return sizes.select("n_nodes", "n_edges", F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1) / F.lit(2.0)), 10).alias("density"))


@q("""with u as (select distinct source_type from content_unified where source_type is not null) select source_type, sha256('{"params":{"type":"' || source_type || '"},"query":"leak"}') as cache_key from u""")
def cache_search_keys(t):
    """Key of a stored search: digest of the query and its parameters as JSON in order of their names."""
    key = F.sha2(F.to_json(F.struct(F.struct(F.col("source_type").alias("type")).alias("params"), F.lit("leak").alias("query"))), 256)
    return t.content_unified.where("source_type is not null").select("source_type").distinct().select("source_type", key.alias("cache_key"))


@q("""select 'content_unified' as "table", count(*) filter (id is null) as null_keys, count(id) - count(distinct id) as repeated_keys from content_unified union all select 'emails', count(*) filter (message_id is null), count(message_id) - count(distinct message_id) from emails
union all select 'document_chunks', count(*) filter (chunk_id is null), count(chunk_id) - count(distinct chunk_id) from document_chunks union all select 'content_embeddings', count(*) filter (id is null), count(id) - count(distinct id) from content_embeddings""")
def integrity_keys(t):
    """Null and repeated keys per table."""
    one = lambda name, key: getattr(t, name).agg(F.count_if(F.col(key).isNull()).alias("null_keys"), (F.count(key) - F.countDistinct(key)).alias("repeated_keys")).withColumn("table", F.lit(name))
    out = one("content_unified", "id")
    for name, key in (("emails", "message_id"), ("document_chunks", "chunk_id"), ("content_embeddings", "id")):
        out = out.unionByName(one(name, key))
    return out.select("table", "null_keys", "repeated_keys")


_FILTERS = ["2024-01-15", "2024/02/29", "01/15/2024", "15/01/2024", "02-03-2023", "2024-01-15 10:30:00", "2024-01-15 10:30", "15.01.2024", "", "2024-13-01"]
_FORMS = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M"]


@q("with s(given) as (values " + ", ".join(f"('{x}')" for x in _FILTERS) + ") select given, coalesce(" + ", ".join(f"try_strptime(given, '{f}')" for f in _FORMS) + ") as at from s")
def date_filters(t):
    """Dates typed as a filter, by seven forms in order, month before day where both fit."""
    return t.spark.createDataFrame([(x,) for x in _FILTERS], "given string").select("given", N.date_filter("given").alias("at"))


@q(r"""with p as (select id, trim(p, chr(10) || chr(13) || chr(9) || ' ') as p, row_number() over () as k from (select id, unnest(string_split(replace(replace(body, '. ', '.' || chr(10) || chr(10)), 'The ', '• The '), chr(10) || chr(10))) as p from content_unified where body is not null and chunk_index is not distinct from 0))
select id, count(*) filter (p <> '')::bigint as n_paragraphs, count(*) filter (starts_with(p, '•'))::bigint as n_bullets from p group by 1""")
def text_markdown_counts(t):
    """Paragraphs and bullets of bodies laid out as markdown."""
    body = F.replace(F.replace("body", F.lit(". "), F.lit(".\n\n")), F.lit("The "), F.lit("• The "))
    parts = N.paragraphs_of(body)
    return t.content_unified.where("body is not null and chunk_index <=> 0").select("id", F.size(parts).cast("long").alias("n_paragraphs"), F.size(F.filter(parts, lambda p: F.startswith(p, F.lit("•")))).cast("long").alias("n_bullets"))


@q("""select content_pair_hash, case when s > 0.99 then 'exact' when s > 0.8 then 'near' when s > 0.5 then 'somewhat' else 'different' end as verdict, count(*) as n from (select content_pair_hash, similarity_score as s from similarity_cache where similarity_score is not null) group by 1, 2""")
def copies_verdicts(t):
    """Scores of compared documents in words."""
    s = F.col("similarity_score")
    return t.similarity_cache.where("similarity_score is not null").groupBy("content_pair_hash", F.when(s > 0.99, "exact").when(s > 0.8, "near").when(s > 0.5, "somewhat").otherwise("different").alias("verdict")).agg(F.count("*").alias("n"))


@q("select id, sender, datetime_utc from emails where (contains(lower(sender), 'orsay') or contains(lower(sender), 'dunmere')) and datetime_utc >= timestamp '2022-06-01'")
def filter_senders_since(t):
    """Mail of stated senders from a day on."""
    who = F.contains(F.lower("sender"), F.lit("orsay")) | F.contains(F.lower("sender"), F.lit("dunmere"))
    return t.emails.where(who & (F.col("datetime_utc") >= F.lit("2022-06-01").cast("timestamp_ntz"))).select("id", "sender", "datetime_utc")


@q(r"""with e as (select id, message_id, sender, datetime_utc from emails where id = (select min(id) from emails)), n as (select count(*) as n_entities, count(distinct entity_text) as n_distinct from email_entities where message_id = (select message_id from e)),
c as (select count(*) as n_contents from content_unified where source_id = (select trim(message_id, '<>') from e)) select e.id, e.sender, e.datetime_utc, n.n_entities, n.n_distinct, c.n_contents from e, n, c""")
def join_evidence_record(t):
    """One mail with the numbers of its entities and stored contents."""
    one = t.emails.join(F.broadcast(t.emails.agg(F.min("id").alias("id"))), "id").select("id", "message_id", "sender", "datetime_utc")
    named = t.email_entities.join(F.broadcast(one.select("message_id")), "message_id", "left_semi").agg(F.count("*").alias("n_entities"), F.countDistinct("entity_text").alias("n_distinct"))
    stored = t.content_unified.join(F.broadcast(one.select(F.trim(F.col("message_id"), F.lit("<>")).alias("source_id"))), "source_id", "left_semi").agg(F.count("*").alias("n_contents"))
    return one.drop("message_id").join(named).join(stored)


_MARKS = [r"this (?:e-?mail|message) (?:may contain|is) [^.\n]*", r"if you (?:have )?received this [^.\n]*", r"all rights reserved"]


@q("with c as (select id, content, " + "regexp_replace(" * 3 + "content" + "".join(f", '{m}', '[BOILERPLATE REMOVED]', 'gi')" for m in _MARKS) + " as clean, " + " + ".join(f"len(regexp_extract_all(content, '(?i){m}'))" for m in _MARKS) + " as removals from emails where length(content) > 0) select id, removals::bigint as removals, length(clean)::bigint as cleaned_length, round((length(content) - length(clean)) * 100.0 / length(content), 6) as reduction from c where removals > 0")
def boilerplate_marked(t):
    """Standing phrases replaced by a marker, with their number and what was saved in per cent."""
    clean, n = F.col("content"), F.lit(0)
    for m in _MARKS:
        clean, n = F.regexp_replace(clean, "(?i)" + m, "[BOILERPLATE REMOVED]"), n + F.regexp_count("content", F.lit("(?i)" + m))
    rows = t.emails.where("length(content) > 0").select("id", F.length("content").alias("before"), F.length(clean).alias("after"), n.cast("long").alias("removals")).where("removals > 0")
    return rows.select("id", "removals", F.col("after").cast("long").alias("cleaned_length"), F.round((F.col("before") - F.col("after")) * 100.0 / F.col("before"), 6).alias("reduction"))


_PASS = "select distinct doc_id, source, unnest(string_split(text, chr(10) || chr(10))) as p from documents where source is not null"


@q(rf"""with p as ({_PASS}), k as (select distinct doc_id, source, regexp_replace(trim(regexp_replace(lower(p), '[ \t\n\r\f]+', ' ', 'g')), '\d+', '[NUM]', 'g') as passage from p where length(trim(p)) > 20), n as (select source, count(distinct doc_id) as total from documents where source is not null group by 1)
select source, passage, count(*) as frequency, round(least(0.95, count(*)::double / any_value(total)), 8) as confidence from k join n using (source) group by 1, 2 having count(*) >= 2 and count(*) >= any_value(total) * 0.3""")
def boilerplate_frequent(t):
    """Passages that at least two documents and three tenths of a source's documents hold."""
    rows = t.documents.where("source is not null").select("doc_id", "source", F.explode(F.split("text", "\n\n")).alias("p")).where(F.length(F.trim("p")) > 20)
    keys = rows.select("doc_id", "source", X.text_key("p").alias("passage")).distinct().groupBy("source", "passage").agg(F.count("*").alias("frequency")).where("frequency >= 2")
    total = t.documents.where("source is not null").groupBy("source").agg(F.countDistinct("doc_id").alias("total"))
    return G.many_to_one(keys, total, "source").where("frequency >= total * 0.3").select("source", "passage", "frequency", F.round(F.least(F.lit(0.95), F.col("frequency") / F.col("total")), 8).alias("confidence"))


_B = "select id, bucket, sum(n) as n from (select {i} as id, ('0x' || substr(md5(w), 1, 8))::bigint % 64 as bucket, count(*) as n from (select {i}, unnest(regexp_extract_all(lower({t}), '[a-z0-9]+')) as w from {f}) group by {i}, w) group by 1, 2"


@q(f"""with d as ({_B.format(i='doc_id', t='text', f='documents')}), a as ({_B.format(i='k', t='q', f="(select 0 as k, 'roof leak deposit hearing' as q)")}),
s as (select d.id, sum(d.n * a.n) as dot, sqrt(sum(d.n * d.n)) as size from d left join a using (bucket) group by 1) select id, round(dot / (size * (select sqrt(sum(n * n)) from a)), 8) as sim from s where dot > 0 order by sim desc, id limit 10""")
def vector_text_search(t):
    """Texts nearest to a typed query by hashed words."""
    hits = E.hashed_similarity(t.documents.select(F.col("doc_id").alias("id"), "text"), "roof leak deposit hearing")
    return hits.select("id", F.round("sim", 8).alias("sim")).orderBy(F.desc("sim"), "id").limit(10)


@q("select id, sender, subject from emails where contains(lower(sender), 'orsay') and contains(lower(subject), 'question') and datetime_utc >= timestamp '2022-01-01' and datetime_utc < timestamp '2025-01-01' and contains(lower(content), 'leak')")
def filter_mail_search(t):
    """Mail by a search string with from:, subject:, after:, before: and words."""
    return t.emails.where(N.mail_search("from:orsay subject:question after:2022/01/01 before:2025/01/01 leak")).select("id", "sender", "subject")


@q("""with d as (select datetime_utc::date as day, date_trunc('hour', datetime_utc) as hour, count(*) as n, min(id) as first_id from emails where datetime_utc is not null group by 1, 2)
select day::varchar as day, '## ' || day || chr(10) || string_agg('- ' || strftime(hour, '%H:00') || ' (' || n || ', from ' || first_id || ')', chr(10) order by hour) as section from d group by day""")
def timeline_markdown(t):
    """A section of markdown per day, a line per hour: at most 24 lines a day, whatever its load."""
    hours = t.emails.where("datetime_utc is not null").groupBy(F.to_date("datetime_utc").alias("day"), F.date_trunc("hour", "datetime_utc").alias("hour")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    line = F.concat(F.lit("- "), F.date_format("hour", "HH:00"), F.lit(" ("), F.col("n").cast("string"), F.lit(", from "), F.col("first_id").cast("string"), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("hour", line.alias("line")))), lambda x: x["line"])
    return hours.groupBy("day").agg(F.array_join(lines, "\n").alias("lines")).select(F.col("day").cast("string").alias("day"), F.concat(F.lit("## "), F.col("day").cast("string"), F.lit("\n"), "lines").alias("section"))


@q(r"""with r as (select doc_id, unnest(regexp_extract_all(text, '\b(?:[Pp]laintiff|[Dd]efendant|[Aa]ttorney|[Jj]udge|[Ww]itness)\b[^A-Z\n]{0,50}([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})\b', 1)) as name from documents)
select name, count(*) as n, count(distinct doc_id) as n_docs, 0.75 as confidence from r group by 1""")
def entity_roles(t):
    """Names of two or three capitalised words within 50 characters behind a word for a role."""
    rows = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:[Pp]laintiff|[Dd]efendant|[Aa]ttorney|[Jj]udge|[Ww]itness)\b[^A-Z\n]{0,50}([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})\b"), F.lit(1))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).withColumn("confidence", F.lit(0.75))


@q("select chunk_id, case when status = 'failed' then 'failed before' when coalesce(text_content, '') = '' then 'no text' when char_count is distinct from length(text_content) then 'wrong length' end as fault, count(*) as n from document_chunks group by 1, 2")
def sink_quarantine(t):
    """Rows split by the first rule they break; null is a good row."""
    fault = F.when(F.col("status") == "failed", "failed before").when(F.coalesce("text_content", F.lit("")) == "", "no text").when(~F.col("char_count").eqNullSafe(F.length("text_content")), "wrong length")
    return t.document_chunks.groupBy("chunk_id", fault.alias("fault")).agg(F.count("*").alias("n"))


@q("select id, lower(trim(coalesce(nullif(regexp_extract(sender, '<([^<>]+)>', 1), ''), sender))) as address, trim(regexp_replace(coalesce(subject, ''), '[ \t\n\r\f]+', ' ', 'g')) as subject, length(trim(regexp_replace(coalesce(content, ''), '[ \t\n\r\f]+', ' ', 'g')))::int as n_chars from emails")
def text_cleaned_mail(t):
    """Address, subject and body of mails put in order."""
    address = F.coalesce(F.nullif(F.regexp_extract("sender", "<([^<>]+)>", 1), F.lit("")), "sender")
    return t.emails.select("id", F.lower(F.trim(address)).alias("address"), X.squeeze(F.coalesce("subject", F.lit(""))).alias("subject"), F.length(X.squeeze(F.coalesce("content", F.lit("")))).alias("n_chars"))


@q("""with e as (select md5(id || ':' || coalesce(message_id, '')) as event_id, subject as title, datetime_utc as event_date, least(10, length(coalesce(content, '')) // 500)::int as importance from emails where datetime_utc is not null),
n as (select count(*) as n, count(distinct event_id) as n_ids, sum(importance)::bigint as weight from e) select * from n""")
def timeline_created(t):
    """Events made of mails, with ids that stay the same when they are made again."""
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), F.coalesce("message_id", F.lit(""))))
    weight = F.least(F.lit(10), F.floor(F.length(F.coalesce("content", F.lit(""))) / 500)).cast("int")
    rows = t.emails.where("datetime_utc is not null").select(key.alias("event_id"), F.col("subject").alias("title"), F.col("datetime_utc").alias("event_date"), weight.alias("importance"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.sum("importance").alias("weight"))


@q()
def boilerplate_similar(t):
    """Passages that are nearly alike in several documents: classes of near copies among distinct passages."""
    rows = t.documents.select("doc_id", F.explode(F.split("text", "\n\n")).alias("p")).where(F.length(F.trim("p")) > 20).select("doc_id", X.text_key("p").alias("text"))
    passages = rows.groupBy("text").agg(F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("n_docs")).withColumn("id", F.xxhash64("text"))
    groups = C.near_copies(passages.select("id", "text"))
    return passages.join(groups, "id").groupBy("group_id").agg(F.count("*").alias("n_passages"), F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc")).where("n_passages > 1")


# --- Raw records and files, made from the tables and read back ---
def raw_messages(t):
    """Mails as raw records of a mail service: headers, URL-safe base64 and parts."""
    data = F.translate(F.base64(F.encode("content", "UTF-8")), "+/\r\n", "-_")
    head = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("value"))
    date = F.date_format(F.col("datetime_utc"), "EEE, d MMM yyyy HH:mm:ss")
    part = lambda kind, name, d, n: F.struct(F.lit(kind).alias("mimeType"), name.alias("filename"), F.struct(d.alias("data"), n.alias("size")).alias("body"))
    none = F.lit(None).cast("string")
    parts = F.array(part("text/html", F.lit(""), F.base64(F.encode(F.lit("<p>other</p>"), "UTF-8")), F.lit(12)), part("text/plain", F.lit(""), data, F.length("content")), part("application/pdf", F.concat("id", F.lit(".pdf")), none, F.length("content")))
    headers = F.array(head("subject", F.col("subject")), head("FROM", F.col("sender")), head("To", F.col("recipient_to")), head("Date", date))
    return t.emails.where("content is not null").select(F.col("id").cast("string").alias("id"), F.col("thread_id").alias("threadId"), F.struct(headers.alias("headers"), F.struct(none.alias("data")).alias("body"), parts.alias("parts")).alias("payload"))


@q("select id::varchar as id, thread_id, subject, sender, recipient_to, date_trunc('second', datetime_utc) as sent, sha256(content) as digest from emails where content is not null")
def mail_parsed(t):
    """Raw records flattened: the plain part is the body, headers in any case."""
    got = M.parsed_messages(raw_messages(t))
    return got.select("id", "thread_id", "subject", "sender", "recipient_to", F.col("sent").cast("timestamp_ntz").alias("sent"), F.sha2("body", 256).alias("digest"))


@q("select id::varchar as id, id || '.pdf' as filename, 'application/pdf' as mime_type, length(content)::int as size from emails where content is not null")
def mail_attachments(t):
    return M.attachments(raw_messages(t)).select("id", "filename", "mime_type", "size")


def stored_files(t):
    """Documents as files of several formats, some without an ending."""
    kind = F.element_at(F.array(F.lit(".md"), F.lit(".txt"), F.lit(".HTML"), F.lit(""), F.lit(".pdf")), (F.col("doc_id") % 5 + 1).cast("int"))
    start = F.when(F.col("doc_id") % 5 == 4, "%PDF-1.7 ").when(F.col("doc_id") % 5 == 0, F.concat(F.lit("---\ntitle: "), F.col("doc_id").cast("string"), F.lit("\n---\n"))).otherwise("")
    return t.documents.where("length(text) > 20").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), kind).alias("path"), F.encode(F.concat(start, F.col("text")), "UTF-8").alias("content"))


@q("select case doc_id % 5 when 0 then 'markdown' when 1 then 'text' when 2 then 'html' when 3 then 'text' else 'pdf' end as format, count(*) as n from documents where length(text) > 20 group by 1")
def file_formats(t):
    return L.with_format(stored_files(t)).groupBy("format").agg(F.count("*").alias("n"))


@q("select '/in/' || doc_id || '.txt' as path, sha256(text) as digest, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) = text as unchanged from documents where length(text) > 20 and doc_id % 5 = 1")
def file_texts(t):
    got = L.texts(stored_files(t).where("endswith(path, '.txt')"))
    return got.select("path", F.col("sha256").alias("digest"), (F.sha2("text", 256) == F.col("sha256")).alias("unchanged"))


@q("select '/in/' || doc_id || '.md' as path, 'title: ' || doc_id as head, sha256(text) as digest from documents where length(text) > 20 and doc_id % 5 = 0 and not contains(text, chr(13))")
def file_front_matter(t):
    got = L.texts(stored_files(t).where("endswith(path, '.md')"))
    head, body = L.front_matter("text")
    return got.where(~F.contains(F.decode(F.encode("text", "UTF-8"), "UTF-8"), F.lit("\r"))).select("path", head.alias("head"), F.sha2(body, 256).alias("digest"))


QUERIES, ORACLE = book.queries, book.oracle
