"""Queries on the similarity graph of content."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import graph as G
from quillstack.plans.book import Book

book = Book()
q = book.query

_E = """e as (select least(a, b) as src, greatest(a, b) as dst, max(s) as strength, case when max(s) >= 0.9 then 'similar_to' else 'related_to' end as relation from (
  select try_cast(trim(content_id_1) as bigint) as a, try_cast(trim(content_id_2) as bigint) as b, similarity_score as s from similarity_cache where similarity_score >= 0.7) where a <> b group by 1, 2),
ways as (select src as node, dst as other, relation, strength from e union all select dst, src, relation, strength from e)"""
W = f"with {_E} "
R = f"with recursive {_E}, "


def edges(t):
    return G.similarity_edges(t.similarity_cache)


@q(W + "select src, dst, relation, strength from e")
def graph_edges(t):
    return edges(t)


@q(W + "select src, dst, a.source_type as src_type, b.source_type as dst_type, strength from e join content_unified a on a.id = src join content_unified b on b.id = dst where a.source_type in ('document', 'email_message')")
def graph_edge_ends(t):
    kinds = t.content_unified.select("id", "source_type")
    left = kinds.where(F.col("source_type").isin("document", "email_message")).select(F.col("id").alias("src"), F.col("source_type").alias("src_type"))
    return edges(t).join(left, "src").join(kinds.select(F.col("id").alias("dst"), F.col("source_type").alias("dst_type")), "dst").select("src", "dst", "src_type", "dst_type", "strength")


@q(W + "select node, other, relation, strength, title from ways join content_unified on id = other")
def graph_related(t):
    return G.related(t.content_unified, edges(t))


@q(W + "select node, other, strength from ways where relation = 'similar_to'")
def graph_neighbours(t):
    return G.both_ways(edges(t).where("relation = 'similar_to'")).select("node", "other", "strength")


@q(W + "select c.id, count(w.node) as degree, round(avg(w.strength), 8) as mean_strength from content_unified c left join ways w on w.node = c.id group by 1 having count(w.node) > 0")
def graph_degrees(t):
    return G.degrees(edges(t)).join(t.content_unified.select(F.col("id").alias("node")), "node").select(F.col("node").alias("id"), "degree", F.round("mean_strength", 8).alias("mean_strength"))


@q(W + "select relation, count(*) as n, count(distinct src) as n_src, round(avg(strength), 8) as mean, min(strength) as low, max(strength) as high from e group by 1")
def graph_statistics(t):
    return edges(t).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.round(F.avg("strength"), 8).alias("mean"), F.min("strength").alias("low"), F.max("strength").alias("high"))


@q(W + "select count(*) as n_edges, count(distinct src) + count(distinct dst) - (select count(*) from (select src from e intersect select dst from e)) as n_nodes from e")
def graph_size(t):
    es = edges(t)
    ends = es.agg(F.count(F.lit(1)).alias("n_edges"))
    nodes = es.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.countDistinct("id").alias("n_nodes"))
    return ends.crossJoin(nodes)


@q(R + """walk(id, depth) as (select min(src), 0 from e union select w.other, depth + 1 from walk join ways w on w.node = id where depth < 3)
select id, min(depth) as depth from walk group by 1""")
def graph_breadth_first(t):
    es = edges(t)
    return G.breadth_first(es, es.agg(F.min("src").alias("id")), 3)


@q(R + """walk(id, depth) as (select min(src), 0 from e union select w.other, depth + 1 from walk join ways w on w.node = id where depth < 2),
near as (select id, min(depth) as depth from walk group by 1)
select n.id, n.depth, max(w.strength) / (n.depth + 1) as score from near n join ways w on w.node = n.id where n.depth > 0 group by 1, 2 order by score desc, id limit 20""")
def graph_related_ranked(t):
    es = edges(t)
    near = G.breadth_first(es, es.agg(F.min("src").alias("id")), 2).where("depth > 0")
    best = G.degrees(es).select(F.col("node").alias("id"), "best_strength")
    return near.join(best, "id").select("id", "depth", (F.col("best_strength") / (F.col("depth") + 1)).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@q(R + """best as (select src, dst from e order by strength desc, src, dst limit 1),
walk(path, tip, total) as (select [node, other], other, strength from ways where node = (select src from best)
  union all select list_append(path, w.other), w.other, total + w.strength from walk join ways w on w.node = tip where tip <> (select dst from best) and not list_contains(path, w.other) and len(path) <= 3)
select path, len(path) - 1 as length, total / (len(path) - 1) as mean_strength from walk where tip = (select dst from best) order by length, mean_strength desc, path limit 5""")
def graph_paths(t):
    es = edges(t)
    top = es.orderBy(F.desc("strength"), "src", "dst").first()
    if top is None:
        return es.select(F.array("src").alias("path"), F.lit(0).alias("length"), F.col("strength").alias("mean_strength"))
    return G.simple_paths(es, top["src"], top["dst"], 3).orderBy("length", F.desc("mean_strength"), "path").limit(5)


_PR = ", ".join(f"r{k} as (select n.id, n_out, 0.15 / (select count(*) from nodes) + 0.85 * coalesce(i.inflow, 0) as rank from nodes n left join (select e.dst as id, sum(r.rank / r.n_out) as inflow from e join r{k - 1} r on r.id = e.src where r.n_out is not null group by 1) i on i.id = n.id)" for k in range(1, 11))
_RANKS = W + f", deg as (select src as id, count(*) as n_out from e group by 1), nodes as (select i.id, deg.n_out from (select src as id from e union select dst from e) i left join deg on deg.id = i.id), r0 as (select id, n_out, 1.0::double / (select count(*) from nodes) as rank from nodes), {_PR} "


@q(_RANKS + "select id, round(rank / (select sum(rank) from r10), 9) as rank from r10")
def graph_pagerank(t):
    return G.pagerank(edges(t)).select("id", F.round("rank", 9).alias("rank"))


@q()
def graph_pagerank_converged(t):
    """Ranks until none changes by a ten-thousandth, in at most a hundred rounds."""
    return G.pagerank(edges(t), rounds=100, epsilon=1e-4).select("id", F.round("rank", 9).alias("rank"))


@q(_RANKS + "select r.id, c.title, round(rank / (select sum(rank) from r10), 7) as rank from r10 r join content_unified c on c.id = r.id order by rank desc, r.id limit 10")
def graph_top_ranked(t):
    ranks = G.pagerank(edges(t)).join(t.content_unified.select("id", "title"), "id")
    return ranks.select("id", "title", F.round("rank", 7).alias("rank")).orderBy(F.desc("rank"), "id").limit(10)


@q(W + "select src, dst, strength from e where src in (select id from content_unified where source_type = 'email_message') and dst in (select id from content_unified where source_type = 'email_message')")
def graph_induced(t):
    return G.induced(edges(t), t.content_unified.where("source_type = 'email_message'")).select("src", "dst", "strength")


@q(W + "select src as source, dst as target, round(strength * 10, 6) as width, relation from e")
def graph_links(t):
    return edges(t).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.round(F.col("strength") * 10, 6).alias("width"), "relation")


@q("""with recursive e as (select distinct least(a, b) as src, greatest(a, b) as dst from (select try_cast(trim(content_id_1) as bigint) as a, try_cast(trim(content_id_2) as bigint) as b from similarity_cache where similarity_score >= 0.85) where a <> b),
ways as (select src as x, dst as y from e union all select dst, src from e), reach(x, y) as (select distinct x, x from ways union select r.x, w.y from reach r join ways w on w.x = r.y),
lab as (select x as id, min(y) as component from reach group by 1)
select component, count(*) as size, list_sort(list(id))[1:10] as sample from lab group by 1 having count(*) >= 3""")
def graph_clusters(t):
    groups = G.components(G.similarity_edges(t.similarity_cache, 0.85))
    ranked = G.top_per(groups, "component", [F.col("id")], 10).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("sample"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    return sizes.join(ranked, "component")


@q("""with p as (select id, similarity_score as s, try_cast(trim(content_id_1) as bigint) as a, try_cast(trim(content_id_2) as bigint) as b from (select row_number() over () as id, * from similarity_cache)) select count(s) as n, round(avg(s), 8) as mean, median(s) as median, round(stddev_pop(s), 8) as spread, min(s) as low, max(s) as high, count(*) filter (s >= 0.7) as n_similar from p""")
def graph_score_distribution(t):
    s = F.col("similarity_score")
    return t.similarity_cache.agg(F.count(s).alias("n"), F.round(F.avg(s), 8).alias("mean"), F.median(s).alias("median"), F.round(F.stddev_pop(s), 8).alias("spread"), F.min(s).alias("low"), F.max(s).alias("high"), F.count_if(s >= 0.7).alias("n_similar"))


@q("""select a, b, max(similarity_score) as score, md5(least(a, b)::varchar || '||' || greatest(a, b)::varchar) as key, case when max(similarity_score) >= 0.99 then 'identical' when max(similarity_score) >= 0.8 then 'very similar' when max(similarity_score) >= 0.5 then 'similar' else 'different' end as verdict
from (select x, y, least(x, y) as a, greatest(x, y) as b, similarity_score from (select try_cast(trim(content_id_1) as bigint) as x, try_cast(trim(content_id_2) as bigint) as y, similarity_score from similarity_cache)) where similarity_score is not null and x is not null and y is not null group by 1, 2""")
def graph_pair_verdicts(t):
    x, y = G.pair_id(F.col("content_id_1")), G.pair_id(F.col("content_id_2"))
    ids = t.similarity_cache.where(F.col("similarity_score").isNotNull() & x.isNotNull() & y.isNotNull()).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "similarity_score")
    best = ids.groupBy("a", "b").agg(F.max("similarity_score").alias("score"))
    key = F.md5(F.concat_ws("||", F.col("a").cast("string"), F.col("b").cast("string")))
    s = F.col("score")
    return best.select("a", "b", "score", key.alias("key"), F.when(s >= 0.99, "identical").when(s >= 0.8, "very similar").when(s >= 0.5, "similar").otherwise("different").alias("verdict"))


@q("""with p as (select distinct message_id, normalized_form as e from email_entities where entity_type in ('PERSON', 'ORG') and normalized_form is not null),
hub as (select e from p group by 1 order by count(*) desc, e limit 1)
select o.e as entity, count(*) as together from p h join p o on o.message_id = h.message_id and o.e <> h.e where h.e = (select e from hub) group by 1 having count(*) >= 2 order by together desc, entity limit 20""")
def graph_entity_network(t):
    """Entities named in the same mails as the most named one."""
    named = t.email_entities.where(F.col("entity_type").isin("PERSON", "ORG") & F.col("normalized_form").isNotNull()).select("message_id", F.col("normalized_form").alias("entity")).distinct()
    hub = named.groupBy("entity").count().orderBy(F.desc("count"), "entity").limit(1).select(F.col("entity").alias("hub"))
    mails = named.join(F.broadcast(hub), F.col("entity") == F.col("hub"), "left_semi").select("message_id")
    near = named.join(mails, "message_id", "left_semi").join(F.broadcast(hub), F.col("entity") == F.col("hub"), "left_anti")
    return near.groupBy("entity").agg(F.count(F.lit(1)).alias("together")).where("together >= 2").orderBy(F.desc("together"), "entity").limit(20)


@q("""with p as (select distinct message_id, normalized_form as e from email_entities where entity_type = 'ORG' and normalized_form is not null)
select a.e as entity_1, b.e as entity_2, count(*) as together from p a join p b on a.message_id = b.message_id and a.e < b.e group by 1, 2 having count(*) >= 2 order by together desc, entity_1, entity_2 limit 10""")
def graph_cooccurrence(t):
    """Pairs of firms named in the same mails. Mails name a handful of firms, so pairs are made within a mail only."""
    named = t.email_entities.where("entity_type = 'ORG' and normalized_form is not null").select("message_id", F.col("normalized_form").alias("e")).distinct()
    per_mail = named.groupBy("message_id").agg(F.array_sort(F.collect_set("e")).alias("es")).where("size(es) > 1")
    pairs = per_mail.select(F.posexplode("es").alias("at", "entity_1"), "es").select("entity_1", F.explode(F.slice("es", F.col("at") + 2, F.size("es"))).alias("entity_2"))
    return pairs.groupBy("entity_1", "entity_2").agg(F.count(F.lit(1)).alias("together")).where("together >= 2").orderBy(F.desc("together"), "entity_1", "entity_2").limit(10)


QUERIES, ORACLE = book.queries, book.oracle
