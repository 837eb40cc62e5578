"""Property graph operators over edges (src, dst, relation, strength); ids are numbers.

Edges count both ways for neighbourhoods and traversals. Traversals extend a frontier by one equi join per step and write each
frontier to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.operators.lineage import scratch
from quillstack.operators.skew import hot_list, many_to_one


def pair_id(c: Column) -> Column:
    """Content id written as text; blanks and leading zeros do not matter, other text is null."""
    return F.trim(c).try_cast("bigint")


def similarity_edges(cache: DataFrame, least: float = 0.7, strong: float = 0.9) -> DataFrame:
    """One edge per scored pair of different ids, with the best of its scores; from ``strong`` on the relation is 'similar_to'."""
    ids = cache.where(F.col("similarity_score") >= least).select(pair_id(F.col("content_id_1")).alias("a"), pair_id(F.col("content_id_2")).alias("b"), "similarity_score")
    ids = ids.where("a <> b")
    best = ids.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("similarity_score").alias("strength"))
    return best.select("src", "dst", F.when(F.col("strength") >= strong, "similar_to").otherwise("related_to").alias("relation"), "strength")


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, relation, strength): every edge from either end. Replaces a join on 'src or dst' by an equi join."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"), "relation", "strength").select("e.node", "e.other", "relation", "strength")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.avg("strength").alias("mean_strength"), F.max("strength").alias("best_strength"))


def related(nodes: DataFrame, edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(node, other, relation, strength, title): neighbours that have a row in ``nodes`` (id, title)."""
    ways = both_ways(edges if relations is None else edges.where(F.col("relation").isin(relations)))
    return many_to_one(ways.withColumnRenamed("other", "id"), nodes.select("id", "title"), "id").select("node", F.col("id").alias("other"), "relation", "strength", "title")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``nodes`` (id)."""
    keep = nodes.select("id")
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


def breadth_first(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps of ``starts`` (id), each with its least depth."""
    keep = scratch(edges.sparkSession, "bfs")
    ways = keep.keep(both_ways(edges).select("node", "other").distinct())
    seen = front = keep.keep(starts.select("id", F.lit(0).alias("depth")).distinct())
    for d in range(1, depth + 1):
        step = ways.join(front.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id")).distinct()
        front = keep.keep(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def simple_paths(edges: DataFrame, start: int, goal: int, depth: int = 4) -> DataFrame:
    """(path, length, mean_strength): paths from start to goal without repeated nodes, of at most ``depth`` edges."""
    ways = both_ways(edges).select("node", "other", "strength")
    front = ways.where(F.col("node") == start).select(F.array("node", "other").alias("path"), F.col("other").alias("tip"), F.col("strength").alias("total"))
    out = front.where(F.col("tip") == goal)
    for _ in range(depth - 1):
        front = front.where(F.col("tip") != goal).join(ways.withColumnRenamed("node", "tip"), "tip").where(~F.array_contains("path", F.col("other")))
        front = front.select(F.array_append("path", F.col("other")).alias("path"), F.col("other").alias("tip"), (F.col("total") + F.col("strength")).alias("total"))
        out = out.unionByName(front.where(F.col("tip") == goal))
    return out.select("path", (F.size("path") - 1).alias("length"), (F.col("total") / (F.size("path") - 1)).alias("mean_strength"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 10, epsilon: float | None = None) -> DataFrame:
    """(id, rank) over directed edges after ``rounds`` rounds, or with ``epsilon`` as soon as no rank changes by as much in a round.

    Rank of nodes without way out is not spread, the result sums to 1. A node with very many ways in is summed up on the map side first.
    """
    keep = scratch(edges.sparkSession, "pagerank")
    pairs = edges.select("src", "dst")
    out = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    nodes = keep.keep(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(out.withColumnRenamed("src", "id"), "id", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    hot = hot_list(nodes.select("id", F.col("n_out").alias("n")).where("n is not null"), "id", edges.count())
    pairs = keep.keep(pairs)
    ranks = nodes.select("id", "n_out", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        share = ranks.where("n_out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("n_out")).alias("share"))
        into = many_to_one(pairs, share, "src", hot=hot).groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("inflow"))
        before = ranks
        ranks = nodes.join(into, "id", "left").select("id", "n_out", ((1 - damping) / n + damping * F.coalesce("inflow", F.lit(0.0))).alias("rank"))
        if epsilon is not None:
            ranks = keep.keep(ranks)
            if ranks.join(before.select("id", F.col("rank").alias("last")), "id").agg(F.max(F.abs(F.col("rank") - F.col("last")))).first()[0] < epsilon:
                break
        elif k % 5 == 4:
            ranks = keep.keep(ranks)
    total = ranks.agg(F.sum("rank").alias("total"))
    return ranks.crossJoin(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("rank"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable. Every node takes the least label around it and follows its label's label, until nothing changes."""
    keep = scratch(edges.sparkSession, "components")
    ways = keep.keep(both_ways(edges).select("node", "other").distinct())
    hot = hot_list(ways.groupBy("other").agg(F.count(F.lit(1)).alias("n")), "other", ways.count())  # vertices with very many edges
    labels = keep.keep(ways.groupBy(F.col("node").alias("id")).agg(F.least(F.min("other"), F.first("node")).alias("component")))
    while True:
        around = many_to_one(ways.withColumnRenamed("other", "id"), labels, "id", hot=hot).groupBy(F.col("node").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(around, "id").select("id", F.least("component", "near").alias("next"), "component")
        jump = many_to_one(step.withColumnRenamed("id", "of").withColumnRenamed("next", "id"), labels.withColumnRenamed("component", "further"), "id", "left")
        new = keep.keep(jump.select(F.col("of").alias("id"), F.least("id", F.coalesce("further", "id")).alias("next"), "component"))
        moved = new.where("next <> component").isEmpty()
        keep.drop(labels)
        labels = new.select("id", F.col("next").alias("component"))
        if moved:
            return labels


def top_per(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group. Spark limits each task's group before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)
