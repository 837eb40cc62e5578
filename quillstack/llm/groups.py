"""Consolidating pairwise matches into groups.

Leaves are stripped into their only neighbour and chains of vertices of degree two are replaced by one edge, found by list
ranking (pointer jumping over directed edges). Both repeat while they pay. The reduced core is contracted: every vertex joins
the neighbour with the least random rank. Labels then flow back to the removed vertices in reverse order. Each step writes one or
two tables in the shared folder, which ends its lineage. Keys of joins are unique or salted: of the
hot vertices, 64 at most, the numbers are known to the driver, beside counts the only thing it gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators.lineage import Scratch, scratch
from quillstack.operators.skew import hot_list, many_to_one

#: Strip and compress again while a round removes at least this share of the edges.
WORTH = 0.05


def match_id(c: Column) -> Column:
    """Id written as text, with blanks or leading zeros; text that is no number gives null and so no match."""
    return F.trim(c).try_cast("bigint")


def match_edges(pairs: DataFrame, least_score: float = 0.7) -> DataFrame:
    """Distinct undirected matches (a < b): scored at least ``least_score``, ids different and not null."""
    ids = pairs.where(F.col("similarity_score") >= least_score).select(match_id(F.col("content_id_1")).alias("x"), match_id(F.col("content_id_2")).alias("y"))
    return ids.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")


def _degrees(edges: DataFrame) -> DataFrame:
    return _both_ways(edges).groupBy("x").agg(F.count(F.lit(1)).alias("degree"), F.min("y").alias("lo"), F.max("y").alias("hi"))


def strip_leaves(edges: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(links of leaves to their only neighbour, remaining edges and their number). Of two leaves that form a whole group the smaller stays."""
    leaves = _degrees(edges).where("degree = 1").select(F.least("x", "lo").alias("a"), F.greatest("x", "lo").alias("b"), F.col("x").alias("leaf"))
    marked = edges.select("a", "b", F.lit(None).cast("bigint").alias("leaf")).unionByName(leaves).groupBy("a", "b").agg(F.max("leaf").alias("leaf"))
    done, seen = keep.keep_and_count(marked, n=F.count(F.when(F.col("leaf").isNull(), 1)))
    gone = done.where("leaf is not null")
    links = gone.select(F.col("leaf").alias("x"), F.when(F.col("leaf") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("y"))
    return links, done.where("leaf is null").select("a", "b"), seen["n"]


def _jumped(step: DataFrame, known: DataFrame) -> DataFrame:
    """Pointers (x, y) -> (p, q) moved on by the pointers of (p, q); one whose target has none, or one that has ended, ends the chain.

    Ended pointers meet under their own edge, not under the end of their chain, where many may meet.
    """
    ahead = known.select(F.col("x").alias("jp"), F.col("y").alias("jq"), F.lit(False).alias("jd"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
    own = step.withColumn("jp", F.when(F.col("done"), F.col("x")).otherwise(F.col("p"))).withColumn("jq", F.when(F.col("done"), F.col("y")).otherwise(F.col("q"))).withColumn("jd", F.col("done"))
    return own.join(ahead, ["jp", "jq", "jd"], "left").select(
        "x", "y", F.coalesce("p2", "p").alias("p"), F.coalesce("q2", "q").alias("q"), F.least("low", "low2").alias("low"), (F.col("done") | F.col("p2").isNull() | F.col("done2")).alias("done"))


def compress_chains(edges: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame, int] | None:
    """(links of chain vertices to an end of their chain, remaining edges and their number), or None without vertices of degree two.

    ``step`` holds for every directed edge leaving or entering a chain the furthest edge it reaches; each round triples the
    reach. Edges still open when neither their number nor any minimum changes lie on cycles, which shrink to their least vertex.
    """
    inner, seen = keep.keep_and_count(_degrees(edges).where("degree = 2").select("x", "lo", "hi"), n=F.count(F.lit(1)))
    if not seen["n"]:
        return None
    # Directed edge (x, y) with y in a chain goes on to (y, z), z being the other neighbour of y.
    step = inner.select(F.explode(F.array(
        F.struct(F.col("lo").alias("x"), F.col("x").alias("y"), F.col("x").alias("p"), F.col("hi").alias("q")),
        F.struct(F.col("hi").alias("x"), F.col("x").alias("y"), F.col("x").alias("p"), F.col("lo").alias("q")))).alias("e")).select("e.*")
    step = step.select("x", "y", "p", "q", F.least("x", "y", "q").alias("low"), F.lit(False).alias("done"))
    ended: DataFrame | None = None
    state = None
    while True:
        known = step if ended is None else step.unionByName(ended)
        step, seen = keep.keep_and_count(_jumped(_jumped(step, known), known), open=F.count(F.when(~F.col("done"), 1)), low=F.sum(F.when(~F.col("done"), F.hash("low").cast("long"))))
        closed = step.where("done")
        ended = closed if ended is None else ended.unionByName(closed)
        step = step.where(~F.col("done"))
        if not seen["open"] or seen == state:
            break
        state = seen
    cycles = step.groupBy(F.col("y").alias("x")).agg(F.min("low").alias("y"))
    heads = ended.groupBy(F.col("y").alias("x")).agg(F.min("q").alias("y"))
    links = keep.keep(heads.unionByName(cycles.where("x <> y")))
    # Edges with an end in a chain go; a chain entered from outside leaves one edge between its ends.
    chain = inner.select(F.explode(F.array(F.struct(F.least("x", "lo").alias("a"), F.greatest("x", "lo").alias("b")), F.struct(F.least("x", "hi").alias("a"), F.greatest("x", "hi").alias("b")))).alias("e")).select("e.a", "e.b")
    outside = edges.select("a", "b", F.lit(0).alias("gone")).unionByName(chain.select("a", "b", F.lit(1).alias("gone"))).groupBy("a", "b").agg(F.max("gone").alias("gone")).where("gone = 0").select("a", "b")
    bridges = ended.join(inner.select("x"), "x", "left_anti").where(F.col("x") != F.col("q")).select(F.least("x", "q").alias("a"), F.greatest("x", "q").alias("b"))
    left, seen = keep.keep_and_count(outside.unionByName(bridges).distinct(), n=F.count(F.lit(1)))
    return links, left, seen["n"]


def contract(edges: DataFrame, size: int, keep: Scratch, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(link of every vertex to its neighbour, or itself, of least random rank; edges between the classes so formed and their number)."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("v"))
    best = _both_ways(edges).groupBy("x").agg(F.min(rank("y")).alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("m", rank("x"))["v"].alias("y"), "n")
    links = keep.keep(best)
    hot = hot_list(links, "x", size)
    one = many_to_one(edges, links.select(F.col("x").alias("a"), F.col("y").alias("ca")), "a", hot=hot)
    two = many_to_one(one.select("b", "ca"), links.select(F.col("x").alias("b"), F.col("y").alias("cb")), "b", hot=hot)
    left, seen = keep.keep_and_count(two.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), n=F.count(F.lit(1)))
    return links.select("x", "y"), left, seen["n"]


def connected_groups(edges: DataFrame) -> DataFrame:
    """(id, group_id) for every vertex of the undirected ``edges`` (a, b); group_id is the least id of the group.

    Loops and null ends must be gone, as ``match_edges`` does; repeated edges do no harm. No edges give no rows.
    """
    keep = scratch(edges.sparkSession, "groups")
    edges, seen = keep.keep_and_count(edges.select("a", "b").distinct(), n=F.count(F.lit(1)))
    size = total = seen["n"]
    vertices = _degrees(edges).select(F.col("x").alias("id"), F.col("degree").alias("n"))
    removed: list[DataFrame] = []
    while size:
        before = size
        links, edges, size = strip_leaves(edges, keep)
        removed.append(links)
        if size and (packed := compress_chains(edges, keep)) is not None:
            links, edges, size = packed
            removed.append(links)
        if before - size < WORTH * before:
            break
    shrunk: list[DataFrame] = []
    while size:
        links, edges, size = contract(edges, size, keep, len(shrunk) + 1)
        shrunk.append(links)
    if not removed:
        return vertices.select("id", F.col("id").alias("group_id"))
    # Labels of the core: the classes of a round are vertices of that round too, so a round's labels replace those of the next.
    labels: DataFrame | None = None
    for links in reversed(shrunk):
        links = links.select(F.col("x").alias("id"), F.col("y").alias("to"))
        if labels is not None:
            links = keep.keep(_labelled(links, labels, total))
        labels = links.withColumnRenamed("to", "label")
    # Labels of the removed vertices, each round's in a table of its own.
    for links in reversed(removed):
        links = links.select(F.col("x").alias("id"), F.col("y").alias("to"))
        if labels is not None:
            links = keep.keep(_labelled(links, labels, total))
        more = links.withColumnRenamed("to", "label")
        labels = more if labels is None else labels.unionByName(more)
    every = keep.keep(vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    least = keep.keep(every.groupBy("label").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")))
    return many_to_one(every, least.select("label", "group_id"), "label", hot=hot_list(least, "label", total)).select("id", "group_id")


def _labelled(links: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Links (id, to) with the label of ``to``, where it has one; many may link to one vertex."""
    hot = hot_list(links.groupBy("to").agg(F.count(F.lit(1)).alias("n")), "to", total)
    return many_to_one(links, labels.withColumnRenamed("id", "to"), "to", "left", hot=hot).select("id", F.coalesce("label", "to").alias("to"))
