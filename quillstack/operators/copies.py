"""Duplicate texts: exact groups by hash, near groups by MinHash bands verified on word shingles.

Copies are collapsed first: only distinct texts are sketched and compared, and membership is joined back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.text import squeeze
from quillstack.operators.graph import components
from quillstack.operators.lineage import scratch
from quillstack.operators.skew import many_to_one

#: Words of a shingle, similarity from which texts are near, bands and rows of the sketch (finds 0.8 with probability 0.9997).
SHINGLE, NEAR, BANDS, ROWS = 5, 0.8, 20, 5
#: Texts of a band that are compared all with all.
SMALL = 50
#: Rare shingles of a text of a large band by which it meets others first.
EARLY = 8
#: Hashes of words a task remembers.
WORDS_KNOWN = 200_000
_PRIME = np.uint64((1 << 31) - 1)
_A = np.array([(k * 2654435761 + 97) % ((1 << 31) - 2) + 1 for k in range(1, BANDS * ROWS + 1)], np.uint64)
_B = np.array([(k * 40503 + 12345) % ((1 << 31) - 1) for k in range(1, BANDS * ROWS + 1)], np.uint64)


def text_groups(docs: DataFrame) -> DataFrame:
    """(id, digest) of documents (id, text): SHA-256 of the squeezed small-letter text. Null and blank texts take no part."""
    t = squeeze(F.lower("text"))
    return docs.where(t != "").select("id", F.sha2(t, 256).alias("digest"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """(digest, n, first_id): texts that occur more than once."""
    return text_groups(docs).groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


_WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, known: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct 31-bit hashes of runs of SHINGLE words; a shorter text is one shingle. ``known`` remembers hashes of words."""
    known = {} if known is None else known
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.array([known[w] for w in words], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        runs = (runs ^ h[k : k + n]) * _STEP
        runs ^= runs >> np.uint64(31)
    return np.unique(runs >> np.uint64(33))


def shared_part(a: str, b: str) -> Column:
    """Share of common shingles of two arrays without repeats."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def near_copies(docs: DataFrame, least: float = NEAR) -> DataFrame:
    """(id, group_id): documents (id, text) grouped by near equality; group_id is the least id of the group.

    Distinct texts that share a band are compared exactly by the share of common shingles: all of them where at most SMALL share it. In a
    larger band every text first meets the least and the next one in order of id, and so among those that share one of its rare shingles;
    the verified links are grouped as components. Then texts of large bands that are still in different components are compared wherever
    they can be near (``near_by_prefix``), so that no link between components is missing. Documents without words, or without a near copy,
    are groups of their own.
    """
    spark = docs.sparkSession
    keep = scratch(spark, "copies")
    members = keep.keep(text_groups(docs))
    heads = members.groupBy("digest").agg(F.min("id").alias("head"))
    def sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for part in parts:
            ids, sets, keys = [], [], []
            for i, text in zip(part["id"], part["text"]):
                if len(known) > WORDS_KNOWN:
                    known.clear()
                h = shingles(text, known)
                if len(h):
                    sig = np.concatenate([((h[None, :] * _A[k : k + 20, None] + _B[k : k + 20, None]) % _PRIME).min(1) for k in range(0, len(_A), 20)])
                    ids.append(i)
                    sets.append(h.astype(np.int32))
                    keys.append(np.array([xxhash.xxh64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes()) - (1 << 63) for b in range(BANDS)], np.int64))
            yield pd.DataFrame({"id": ids, "shingles": sets, "keys": keys})

    distinct = docs.select("id", "text").join(heads.select(F.col("head").alias("id")), "id", "left_semi")
    sketches = keep.keep(distinct.mapInPandas(sketch, "id long, shingles array<int>, keys array<long>"))
    bands = sketches.select("id", F.posexplode("keys").alias("band", "key"))
    low = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep.keep(bands.join(low, ["band", "key"]))
    few = shared.where(F.col("n") <= SMALL)
    pairs = few.select("band", "key", F.col("id").alias("a")).join(few.select("band", "key", F.col("id").alias("b")), ["band", "key"]).where("a < b").select("a", "b")
    many = shared.where(F.col("n") > SMALL)
    large = None if many.isEmpty() else keep.keep(prefixes(sketches.join(many, "id", "left_semi"), least))
    if large is not None:
        pairs = pairs.unionByName(chained(many, "band", "key")).unionByName(chained(large.where("early"), "shingle"))
    pairs = keep.keep(pairs.distinct())
    sets = sketches.select("id", "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        both = many_to_one(many_to_one(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        links = both.withColumn("sim", shared_part("sa", "sb")).where(F.col("sim") >= least)
        return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("near").alias("relation"), F.col("sim").alias("strength"))

    links = keep.keep(verified(pairs))
    labels = components(links)
    if large is not None:
        rest = keep.keep(verified(near_by_prefix(large, labels, least)))
        if not rest.isEmpty():
            labels = components(links.unionByName(rest))
    named = heads.join(labels.withColumnRenamed("id", "head"), "head", "left").select("digest", F.coalesce("component", "head").alias("group_id"))
    grouped = many_to_one(members, named, "digest").select("id", "group_id")
    return docs.select("id").join(grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def chained(rows: DataFrame, *by: str) -> DataFrame:
    """(a, b), a < b: every row's id with the least and with the next id of its group."""
    w = Window.partitionBy(*by)
    pairs = rows.withColumns({"least_id": F.min("id").over(w), "after": F.lead("id").over(w.orderBy("id"))}).select(F.col("id").alias("b"), F.explode(F.array("least_id", "after")).alias("a"))
    return pairs.where("a is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """(id, size, shingle, at, early): of every text (id, shingles) the shingles, rarest first, of which two near texts share one, with their places.

    A text of n shingles shares at least ``least`` * n with a near one, so one of them is among its first n - least * n + 1. Shingles of one text
    only are left out; ``early`` marks the first EARLY others.
    """
    each = texts.select("id", F.explode("shingles").alias("shingle"))
    counted = many_to_one(each, each.groupBy("shingle").agg(F.count("*").alias("df")), "shingle")
    order = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s")).withColumn("size", F.size("s"))
    order = order.select("id", "size", F.size(F.filter("s", lambda x: x["df"] == 1)).alias("alone"), F.posexplode(F.slice("s", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int"))).alias("at", "x"))
    return order.where("x.df > 1").select("id", "size", F.col("x.shingle").alias("shingle"), "at", (F.col("at") < F.col("alone") + EARLY).alias("early"))


def near_by_prefix(large: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of different components (id, component) that can be near, by the first shingle they share in ``prefixes``.

    Before that shingle they share none, so no more than the shorter rest can be common.
    """
    known = many_to_one(large, labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    side = lambda c: known.select("shingle", F.col("id").alias(c), F.col("size").alias(f"size_{c}"), (F.col("size") - F.col("at")).alias(f"rest_{c}"), F.col("component").alias(f"component_{c}"))
    enough = F.least("rest_a", "rest_b") >= (F.col("size_a") + F.col("size_b")) * (least / (1 + least)) - 1e-9
    return side("a").join(side("b"), "shingle").where((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & enough).select("a", "b").distinct()
