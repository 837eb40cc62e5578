"""Relations between entities: kinds by context, confidence, names in parts, similarity of spellings, ward clusters of small sets."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Relations and the words between two mentions that tell them, in order.
RELATIONS = [("represents", r"(?i)\b(represent|counsel for|on behalf of|attorney)"), ("opposes", r"(?i)\b(versus|v\.|against|sued)\b"), ("employs", r"(?i)\b(employ|works (for|at)|somebody from)\b"), ("signed_with", r"(?i)\b(signed|both)\b"), ("communicates", r"(?i)\b(asked|told|wrote|called|met)\b")]


def relation_of(between: Column) -> Column:
    """The first relation whose words stand in the text between; 'mentioned_with' otherwise."""
    out = F.when(F.lit(False), "")
    for name, pattern in RELATIONS:
        out = out.when(between.rlike(pattern), name)
    return out.otherwise("mentioned_with")


def relation_confidence(base: Column, distance: Column, told: Column) -> Column:
    """Base confidence less distance (0.1 per 50 characters, 0.2 at most), plus 0.1 if words tell the relation, within 0.1..1."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), base - F.least(F.lit(0.2), distance / 500.0) + F.when(told, 0.1).otherwise(0.0)))


def adjacent_relations(mentions: DataFrame, mails: DataFrame, reach: int = 100) -> DataFrame:
    """(message_id, source, target, relation, confidence): each mention (message_id, text, start, end, confidence) with the next of its mail within ``reach`` characters.

    ``mails`` has one row (message_id, content) per message. Mentions without offsets take no part.
    """
    w = Window.partitionBy("message_id").orderBy("start", "end", "text")
    nxt = lambda c: F.lead(c).over(w)
    pairs = mentions.where("start is not null and end is not null").withColumns({"target": nxt("text"), "next_start": nxt("start"), "next_confidence": nxt("confidence")})
    pairs = pairs.where(F.col("next_start") - F.col("end") >= 0).where(F.col("next_start") - F.col("end") <= reach)
    return told_relations(pairs, mails)


def told_relations(pairs: DataFrame, mails: DataFrame) -> DataFrame:
    """(message_id, source, target, relation, confidence) of pairs of mentions, by the text between them; mentions that overlap have none."""
    both = pairs.join(mails.select("message_id", "content"), "message_id")
    gap = F.greatest(F.lit(0), F.col("next_start") - F.col("end"))
    relation = relation_of(F.substring("content", F.col("end") + 1, gap))
    base = F.least(F.coalesce("confidence", F.lit(0.5)), F.coalesce("next_confidence", F.lit(0.5)))
    return both.select("message_id", F.col("text").alias("source"), "target", relation.alias("relation"), F.round(relation_confidence(base, gap, relation != "mentioned_with"), 6).alias("confidence"))


def near_relations(mentions: DataFrame, mails: DataFrame, reach: int = 100) -> DataFrame:
    """As ``adjacent_relations``, but each mention with every later one (by start, end, text) of its mail that starts at most ``reach`` characters behind its end.

    Mentions that overlap are related too. A mention meets the stretches of ``reach`` characters from its start to the end of its reach,
    a later one lies in the stretch of its start, so pairs out of reach are not built.
    """
    m = mentions.where("start is not null and end is not null")
    last = F.least(F.col("end") + reach, F.max("start").over(Window.partitionBy("message_id")))
    stretch = lambda c: F.floor(c / reach)
    left = m.withColumn("last", last).where("last >= start").withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("last")))))
    right = m.select("message_id", F.col("text").alias("target"), F.col("start").alias("next_start"), F.col("end").alias("next_end"), F.col("confidence").alias("next_confidence"), stretch(F.col("start")).alias("stretch"))
    later = F.struct("next_start", "next_end", "target") > F.struct("start", "end", "text")
    pairs = left.join(right, ["message_id", "stretch"]).where(later & (F.col("next_start") - F.col("end") <= reach))
    return told_relations(pairs, mails)


def best_relations(relations: DataFrame) -> DataFrame:
    """One row per source, target and relation with the best confidence and the number of times it was found."""
    return relations.groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def name_parts(c: str) -> dict[str, Column]:
    """Given name, initials and surname of 'Surname, Given M.' and 'Given M. Surname' spellings; post-nominals are put aside."""
    s = F.trim(F.regexp_replace(F.col(c), r"(?i),? (esq|jr|sr)\.?$", ""))
    comma = s.contains(",")
    surname = F.when(comma, F.trim(F.split_part(s, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(s, r"([^ ]+)$", 1))
    rest = F.trim(F.when(comma, F.split_part(s, F.lit(","), F.lit(2))).otherwise(F.regexp_extract(s, r"^(.*) [^ ]+$", 1)))
    return {"given": F.lower(F.regexp_extract(rest, r"^([^ .]+)", 1)), "initials": F.regexp_replace(F.regexp_extract(rest, r"((?:[A-Z]\. ?)+)$", 1), r"[ .]", ""), "surname": F.lower(surname)}


@F.pandas_udf(DoubleType())
def spelling_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two strings, 0 for nulls."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype=float)


def ward_clusters(vectors: DataFrame, by: str, cut: float = 1.0) -> DataFrame:
    """(by, id, cluster): ward clustering of every group's vectors, cut at merge distance ``cut``; clusters are named by their least id.

    Chains of nearest neighbours over (size, centroid) of the whole group find the merges of the full distance matrix without building it:
    memory in proportion to the group's vectors, time to the square of their number. A cluster whose nearest one is further than ``cut``
    is done, as no later merge brings another nearer.
    """

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.stack(group["vector"].to_numpy()).astype(float)
        x -= x.mean(0)  # the expanded squares below lose fewer digits
        label = ward_labels(x, cut)
        ids = group["id"].to_numpy()
        return pd.DataFrame({by: group[by], "id": ids, "cluster": ids[label]})

    kind = vectors.schema[by].dataType.simpleString()
    return vectors.groupBy(by).applyInPandas(cluster, f"{by} {kind}, id long, cluster long")


def ward_labels(x: np.ndarray, cut: float) -> np.ndarray:
    """The least row of the ward cluster of every row of ``x`` (changed in place), merges up to distance ``cut``."""
    n = len(x)
    size, square, label = np.ones(n), (x**2).sum(1), np.arange(n)
    at = np.arange(n)  # the cluster (its least row) in each place; places from ``live`` on are done or merged
    live, chain = n, []

    def leave(p: int) -> None:
        nonlocal live
        live -= 1
        for v in (x, size, square, at):
            v[p] = v[live]
        for k, c in enumerate(chain):
            if c == live:
                chain[k] = p

    while live > 1:
        if not chain:
            chain.append(int(at[:live].argmin()))
        tip = chain[-1]
        d = np.maximum(0, square[:live] + square[tip] - 2 * (x[:live] @ x[tip])) * (2 * size[tip] * size[:live] / (size[tip] + size[:live]))
        d[tip] = np.inf
        near = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[near]:
            near = chain[-2]
        if not np.sqrt(d[near]) <= cut:
            chain.pop()
            leave(tip)
        elif len(chain) > 1 and near == chain[-2]:
            del chain[-2:]
            i, j = (tip, near) if at[tip] < at[near] else (near, tip)
            x[i] = (size[i] * x[i] + size[j] * x[j]) / (size[i] + size[j])
            size[i] += size[j]
            square[i] = x[i] @ x[i]
            label[at[j]] = at[i]
            leave(j)
        else:
            chain.append(near)
    for r in range(n):  # labels point to lower rows, which are settled
        label[r] = label[label[r]]
    return label
