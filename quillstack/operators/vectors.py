"""Exact vector operators over (id, vector): cosine, top-k and pairs above a threshold.

Similarities to stated queries are computed in blocks: the queries are a bounded table, the vectors stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators.graph import top_per

#: Queries shipped to the tasks at once.
BLOCK = 4096
#: Blocks answered in one reading of the vectors; queries multiplied at once in a task.
READ, ROWS = 16, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select("id", "vector").orderBy("id").toLocalIterator():
        ids.append(r["id"])
        rows.append(r["vector"])
        if len(ids) == BLOCK:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def nearest(queries: DataFrame, vectors: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, id, sim): for each query the ``k`` nearest other vectors, or all from similarity ``least`` on.

    Vectors must be of one length and not null; those of no length match nothing. Each task keeps the best k of its batch only, so
    little travels. Ties go to the smaller id. ``READ`` blocks of queries are answered in one reading of the vectors.
    """
    out, held = None, []
    for block in query_blocks(queries):
        held.append(block)
        if len(held) == READ:
            out, held = _read(held, vectors, k, least, out), []
    if held:
        out = _read(held, vectors, k, least, out)
    if out is None:
        return vectors.where(F.lit(False)).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("sim"))
    return out if k is None else top_per(out, "query_id", [F.desc(F.round("sim", 12)), F.col("id")], k).drop("place")


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _read(blocks: list[tuple[np.ndarray, np.ndarray]], vectors: DataFrame, k: int | None, least: float | None, before: DataFrame | None) -> DataFrame:
    shipped = vectors.sparkSession.sparkContext.broadcast([(ids, _unit(rows)) for ids, rows in blocks])

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            own = part["id"].to_numpy()
            x = _unit(np.stack(part["vector"].to_numpy()).astype(np.float64)).T
            for every, rows in shipped.value:
                for lo in range(0, len(every), ROWS):  # a slice of the queries bounds the matrix
                    ids = every[lo : lo + ROWS]
                    sims = rows[lo : lo + ROWS] @ x
                    sims[ids[:, None] == own[None, :]] = -np.inf
                    if least is not None:
                        r, c = np.nonzero(sims >= least)
                    else:
                        sims = sims.round(12)
                        worst = np.partition(sims, -k, axis=1)[:, -k] if k < sims.shape[1] else np.full(len(ids), -np.inf)
                        r, c = np.nonzero((sims >= worst[:, None]) & np.isfinite(sims))  # ties are settled by id further on
                    yield pd.DataFrame({"query_id": ids[r], "id": own[c], "sim": sims[r, c]})

    out = vectors.select("id", "vector").mapInPandas(scan, "query_id long, id long, sim double")
    return out if before is None else before.unionByName(out)


def unit_vectors(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Vectors scaled to length 1 where they are off by ``tolerance`` or more; those of no length stay."""
    size = norm(F.col("vector"))
    off = (F.abs(size - 1) >= tolerance) & (size > 0)
    return rows.withColumn("rescaled", off).withColumn("vector", F.when(off, F.transform("vector", lambda x: (x.cast("double") / size).cast("float"))).otherwise(F.col("vector")))


def dense_clusters(vectors: DataFrame, least: float, members: int = 2) -> DataFrame:
    """(id, cluster) by density: vectors with at least ``members`` vectors (themselves included) within ``least`` are cores, linked cores
    form clusters named by their least core, others join their nearest core's cluster or get -1."""
    from quillstack.operators.graph import components
    from quillstack.operators.lineage import scratch

    keep = scratch(vectors.sparkSession, "dense")
    links = keep.keep(nearest(vectors, vectors, least=least))
    degree = links.groupBy(F.col("query_id").alias("id")).agg((F.count("*") + 1).alias("n"))
    cores = keep.keep(degree.where(F.col("n") >= members).select("id"))
    among = links.join(cores.withColumnRenamed("id", "query_id"), "query_id", "left_semi").join(cores, "id", "left_semi")
    edges = among.where("query_id < id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("near").alias("relation"), F.col("sim").alias("strength"))
    labels = components(edges)
    clusters = keep.keep(cores.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("cluster")))
    border = links.join(cores.withColumnRenamed("id", "query_id"), "query_id", "left_anti").join(clusters, "id").groupBy("query_id").agg(F.max_by("cluster", F.struct("sim", -F.col("id"))).alias("cluster"))
    both = clusters.unionByName(border.select(F.col("query_id").alias("id"), "cluster"))
    return vectors.select("id").join(both, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def assigned(items: DataFrame, clustered: DataFrame, members: int = 10, least: float = 0.6) -> DataFrame:
    """(id, cluster, sim): for every item (id, vector) the cluster whose first ``members`` vectors of ``clustered`` (id, vector, label) are most
    alike on average, null if that mean is not above ``least``. Equal means go to the smaller label.

    The mean cosine to unit vectors is the product with their mean, so each cluster is one vector; items meet all of them in blocks.
    """
    few = top_per(clustered, "label", [F.col("id")], members)
    each = few.withColumn("size", norm(F.col("vector"))).select("label", F.posexplode(F.transform("vector", lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("size")), F.lit(0.0)))).alias("at", "x"))
    means = each.groupBy("label", "at").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    blocks: list[tuple[list, list]] = [([], [])]
    for r in means.orderBy("label").toLocalIterator():
        if len(blocks[-1][0]) == BLOCK:
            blocks.append(([], []))
        blocks[-1][0].append(r["label"])
        blocks[-1][1].append(r["mean"])
    shipped = items.sparkSession.sparkContext.broadcast([(np.array(a), np.array(b, np.float64)) for a, b in blocks if a])

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.array(part["vector"].tolist(), np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            best, label = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
            for names, rows in shipped.value:
                sims = np.round(x @ rows.T, 12)
                k = sims.argmax(1)
                s = sims[np.arange(len(x)), k]
                better = s > best
                best, label = np.where(better, s, best), np.where(better, names[k], label)
            yield pd.DataFrame({"id": part["id"], "cluster": pd.array(np.where(best > least, label, 0), "Int64").copy(), "sim": best}).assign(cluster=lambda d: d["cluster"].where(best > least))

    return items.where(F.col("vector").isNotNull()).select("id", "vector").mapInPandas(scan, "id long, cluster long, sim double")
