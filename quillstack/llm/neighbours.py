"""The most similar vectors of every vector, by robust-pruned directed graphs.

Vectors are dealt to cells by their nearest centroid (fitted on a bounded sample; every vector is indexed), large cells to shards
of bounded size. One graph is built per shard: greedy beam searches propose neighbours, and a candidate is dropped when a kept one
is nearer to it by the factor ALPHA, which keeps diverse edges. Each vector then asks the shards of its PROBES nearest cells by beam
search, in slices of bounded size, and the best answers are merged. Work grows in proportion to the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.operators.graph import top_per
from quillstack.operators.lineage import Scratch, scratch
from quillstack.operators.skew import many_to_one

#: Vectors per cell aimed at; most cells; most vectors in a shard; most queries in a slice.
CELL, MOST_CELLS, SHARD, SLICE = 4096, 4096, 8192, 8192
#: Rows the centroids are fitted on, at most.
SAMPLE = 20_000
#: Cells asked per vector.
PROBES = 4
#: Out-degree, beam width in building and in searching, slack of pruning, nodes opened per step.
DEGREE, BUILD_BEAM, BEAM, ALPHA, OPEN = 24, 40, 40, 1.2, 4


def usable(embeddings: DataFrame, model: str = "legal-bert", dim: int = 64) -> DataFrame:
    """(content_id, vector): one vector per content id, the latest (null dates first, then the larger id), of the given model and length.

    Null, all-zero, wrongly sized and non-finite vectors, and null content ids, take no part; extra columns are ignored.
    """
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = embeddings.where((F.col("model") == model) & (F.col("dim") == dim) & (F.size("vector") == dim) & F.col("content_id").isNotNull())
    rows = rows.select("content_id", "created_at", "id", "vector", length.alias("length")).where("length > 0 and length < double('infinity')")
    latest = F.max_by("vector", F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")), "id"))
    return rows.groupBy("content_id").agg(latest.alias("vector"))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; empty cells take a random sample row."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = norms[:, 0] == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all rows of ``q`` at once: ids and similarities, best first; -1 pads. Rows that are nodes themselves, ``own``, start there too."""
    m, n = len(q), len(x)
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)[:, None]
    ids = np.full((m, beam), -1, np.int32)
    sims = np.full((m, beam), -np.inf, np.float32)
    first = starts[:beam]
    ids[:, : len(first)] = first
    sims[:, : len(first)] = q @ x[first].T
    seen[:, first] = True
    if own is not None and len(first) < beam:
        other = ~np.isin(own, first)
        ids[other, len(first)] = own[other]
        sims[other, len(first)] = np.einsum("ij,ij->i", q[other], x[own[other]])
        seen[other, own[other]] = True
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    opened = ids < 0
    live = np.arange(m)
    seen = seen.ravel()
    while len(live):
        lo, li, ls = opened[live], ids[live], sims[live]
        r = np.arange(len(live))[:, None]
        pick = np.argsort(lo, 1, kind="stable")[:, :OPEN]
        fresh = ~np.take_along_axis(lo, pick, 1)
        nodes = np.where(fresh, np.take_along_axis(li, pick, 1), -1)
        lo[r, pick] = True
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        near.sort(1)
        ok = near >= 0
        ok[:, 1:] &= near[:, 1:] != near[:, :-1]
        # Nodes not seen before, row by row; only those better than the worst of the beam go on.
        at = np.flatnonzero(ok)
        row, node = at // near.shape[1], near.ravel()[at]
        cell = live[row] * n + node
        new = ~seen[cell]
        row, node = row[new], node[new]
        seen[cell[new]] = True
        s = np.einsum("ij,ij->i", q[live[row]], x[node])
        good = s > ls[row, -1]
        row, node, s = row[good], node[good], s[good]
        count = np.bincount(row, minlength=len(live))
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        width = int(count.max(initial=0))
        if width:
            mi, ms = np.full((len(live), width), -1, np.int32), np.full((len(live), width), -np.inf, np.float32)
            mi[row, place], ms[row, place] = node, s
            as_ = np.concatenate([ls, ms], 1)
            top = np.argsort(-as_, 1, kind="stable")[:, :beam]
            ls = np.take_along_axis(as_, top, 1)
            li = np.where(np.isneginf(ls), -1, np.take_along_axis(np.concatenate([li, mi], 1), top, 1))
            lo = np.take_along_axis(np.concatenate([lo, mi < 0], 1), top, 1)
            ids[live], sims[live] = li, ls
        opened[live] = lo
        live = live[~lo.all(1)]
    return ids, sims


def prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of candidate lists (-1 pads) of many nodes at once."""
    cand = np.where(cand == nodes[:, None], -1, cand)
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[cand]
    far = np.where(cand < 0, np.inf, 1 - np.einsum("bd,bkd->bk", x[nodes], v)).astype(np.float32)
    between = 1 - v @ v.transpose(0, 2, 1)
    left, rows = far.copy(), np.arange(len(nodes))
    out = np.full((len(nodes), degree), -1, np.int32)
    for j in range(degree):
        pick = left.argmin(1)
        some = ~np.isinf(left[rows, pick])
        if not some.any():
            break
        out[:, j] = np.where(some, cand[rows, pick], -1)
        left[rows, pick] = np.inf
        left[(alpha * between[rows, pick] <= far) & some[:, None]] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(graph, start nodes) over unit vectors, by inserting growing batches in random order."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int32)
    middle = int((x @ x.mean(0)).argmax())
    starts = np.unique(np.append(rng.choice(n, min(n, 8), replace=False), middle)).astype(np.int32)
    todo = rng.permutation(n).astype(np.int32)
    done, batch = 0, 8
    while done < n:
        part = todo[done : done + batch]
        found, _ = search(x, graph, starts, x[part], beam)
        if done == 0:
            found = np.broadcast_to(todo[: max(batch, len(starts))], (len(part), min(n, max(batch, len(starts))))).copy()
            found = np.concatenate([found, np.broadcast_to(starts, (len(part), len(starts)))], 1)
        graph[part] = prune(x, part, np.concatenate([found, graph[part]], 1), degree)
        # Reverse edges: append, and prune the lists that overflow.
        src = np.repeat(part, degree)
        dst = graph[part].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, at, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        for lo in range(0, len(nodes), 512):
            some, a, c = nodes[lo : lo + 512], at[lo : lo + 512], count[lo : lo + 512]
            extra = np.full((len(some), min(width, int(c.max()))), -1, np.int32)
            r = np.repeat(np.arange(len(some)), c)
            k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            extra[r, k] = src[np.repeat(a, c) + k]
            both = np.concatenate([graph[some], extra], 1)
            if both.shape[1] > 4 * degree:  # hubs: the nearest suffice as candidates of the pruning
                sims = np.where(both < 0, -np.inf, np.einsum("bd,bkd->bk", x[some], x[both]))
                both = np.take_along_axis(both, np.argsort(-sims, 1, kind="stable")[:, : 4 * degree], 1)
            graph[some] = prune(x, some, both, degree)
        done += len(part)
        batch = min(512, 2 * batch)
    return graph, starts


def unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float32)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def nearest_items(vectors: DataFrame, k: int = 5, probes: int = PROBES) -> DataFrame:
    """(content_id, neighbour, sim): the ``k`` most similar others of every row of ``vectors`` (content_id unique, vector).

    Ties go to the smaller id. Fewer than ``k`` others give fewer rows; an empty or one-row table gives none. Exact copies, however many,
    are one node of the graphs; each copy has the others of its class as its nearest, the smallest ids first.
    """
    keep = scratch(vectors.sparkSession, "neighbours")
    marked = keep.keep(vectors.select("content_id", "vector", F.hex(F.xxhash64("vector")).alias("h"), F.hex(F.xxhash64(F.lit(1), "vector")).alias("h2")).select("content_id", "vector", F.concat("h", F.lit("-"), "h2").alias("key")))
    classes = marked.groupBy("key").agg(F.min("content_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = keep.keep(many_to_one(marked.select("content_id", "key"), classes.select("key", "rep"), "key").select("content_id", "rep"))
    others = copies.where("content_id <> rep").select("content_id")
    found = nearest_distinct(marked.join(others, "content_id", "left_anti").select("content_id", "vector"), k, probes, keep)
    # The first k + 1 of a class are enough: one of them may be the asking copy itself.
    first = top_per(copies, "rep", [F.col("content_id")], k + 1).groupBy("rep").agg(F.collect_list("content_id").alias("ids"))
    own = copies.select("rep").distinct().select(F.col("rep").alias("content_id"), F.col("rep").alias("neighbour"), F.lit(1.0).alias("sim"))
    each = many_to_one(found.unionByName(own), first.withColumnRenamed("rep", "neighbour"), "neighbour", "left", hot=[])
    each = each.select("content_id", "sim", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("id"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "id"))), 1, k + 1)
    lists = keep.keep(each.groupBy("content_id").agg(best.alias("best")).withColumnRenamed("content_id", "rep"))
    asking = copies.select("content_id", "rep")
    single = lists.join(copies.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("content_id"), "best")
    every = single.unionByName(many_to_one(asking, lists, "rep").select("content_id", "best"))
    nearest = F.slice(F.filter("best", lambda x: x["id"] != F.col("content_id")), 1, k)
    return every.select("content_id", F.explode(nearest).alias("x")).select("content_id", F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("sim"))


def nearest_distinct(vectors: DataFrame, k: int, probes: int, keep: Scratch) -> DataFrame:
    """``nearest_items`` of vectors without exact copies."""
    spark = vectors.sparkSession
    vectors = keep.keep(vectors)
    n = vectors.count()
    cells = min(MOST_CELLS, max(1, -(-n // CELL)))
    if cells > 1:
        share = min(1.0, SAMPLE / n)
        picked = vectors.where(F.pmod(F.xxhash64("content_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vector").limit(SAMPLE).toPandas()
        centres = fit_centroids(unit(picked["vector"]), min(cells, len(picked)))
    else:
        centres = None
    cells = 1 if centres is None else len(centres)
    ask = min(probes, cells)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                if centres is None:
                    near = np.zeros((len(part), 1), np.int32)
                else:
                    near = np.argsort(-(unit(part["vector"]) @ centres.T), 1, kind="stable")[:, :ask].astype(np.int32)
                yield pd.DataFrame({"content_id": part["content_id"], "vector": part["vector"], "cells": list(near)})

    routed = keep.keep(vectors.mapInPandas(route, "content_id long, vector array<float>, cells array<int>"))
    sizes = routed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / SHARD).cast("int").alias("parts")))  # one row a cell: at most MOST_CELLS
    homes = routed.select("content_id", "vector", F.col("cells")[0].alias("cell")).join(parts, "cell")
    homes = homes.select("content_id", "vector", "cell", F.pmod(F.xxhash64("content_id"), "parts").cast("int").alias("part"))

    def graphs(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("content_id")
        x = unit(group["vector"])
        graph, starts = build(x)
        first = np.zeros(len(x), bool)
        first[starts] = True
        return pd.DataFrame({"cell": group["cell"], "part": group["part"], "content_id": group["content_id"], "vector": list(x), "node": np.arange(len(x), dtype=np.int32), "links": list(graph), "start": first})

    index = keep.keep(homes.groupBy("cell", "part").applyInPandas(graphs, "cell int, part int, content_id long, vector array<float>, node int, links array<int>, start boolean"))
    asked = routed.select("content_id", "vector", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell"))
    asks = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    asks = F.broadcast(keep.keep(asks.join(parts, "cell")))
    slice_of = F.pmod(F.xxhash64("content_id", F.lit(3)), "slices").cast("int")
    queries = asked.join(asks, "cell").select("content_id", "vector", "home", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), slice_of.alias("slice"), F.pmod(F.xxhash64("content_id"), "parts").cast("int").alias("home_part"))
    # A vector that is a node of the shard it asks is there already.
    queries = queries.where((F.col("cell") != F.col("home")) | (F.col("part") != F.col("home_part"))).select("content_id", "vector", "cell", "part", "slice")
    spread = index.join(asks.select("cell", "slices"), "cell").withColumn("own_slice", slice_of).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def answer(key, nodes: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({"content_id": [], "neighbour": [], "sim": []})
        nodes = nodes.sort_values("node")
        x, graph = np.stack(nodes["vector"].to_numpy()).astype(np.float32), np.stack(nodes["links"].to_numpy()).astype(np.int32)
        starts, names = np.flatnonzero(nodes["start"].to_numpy()).astype(np.int32), nodes["content_id"].to_numpy()
        mine = np.flatnonzero(nodes["own_slice"].to_numpy() == nodes["slice"].to_numpy()).astype(np.int32)
        out = []
        for q, who, own in ((x[mine], names[mine], mine), (unit(qs["vector"]) if len(qs) else x[:0], qs["content_id"].to_numpy(), None)):
            for lo in range(0, len(q), 1024):
                ids, sims = search(x, graph, starts, q[lo : lo + 1024], BEAM, None if own is None else own[lo : lo + 1024])
                ids, sims, w = ids[:, : k + 1 + 2], sims[:, : k + 1 + 2], who[lo : lo + 1024]
                ok = (ids >= 0) & (names[ids] != w[:, None])
                r, c = np.nonzero(ok)
                exact = np.einsum("ij,ij->i", q[lo + r].astype(np.float64), x[ids[r, c]].astype(np.float64))
                out.append(pd.DataFrame({"content_id": w[r], "neighbour": names[ids[r, c]], "sim": exact}))
        if not out:
            return pd.DataFrame({"content_id": [], "neighbour": [], "sim": []})
        return pd.concat(out)

    hits = spread.groupBy("cell", "part", "slice").cogroup(queries.groupBy("cell", "part", "slice")).applyInPandas(answer, "content_id long, neighbour long, sim double")
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("content_id").orderBy(F.desc("sim"), "neighbour")))
    return ranked.where(F.col("place") <= k).select("content_id", "neighbour", "sim")


def neighbour_pairs(nearest: DataFrame) -> DataFrame:
    """Distinct pairs (content_id_1 < content_id_2) of which one is among the nearest of the other."""
    return nearest.select(F.least("content_id", "neighbour").alias("content_id_1"), F.greatest("content_id", "neighbour").alias("content_id_2")).distinct()
