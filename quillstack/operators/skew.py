"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows; there can be at most 1 / share such keys.
HOT_SHARE = 1 / 64
#: Rows that one task takes in its stride: a key with fewer is never hot.
HOT_LEAST = 20_000


def join_hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of all non-null keys: at most ``1 / share`` rows, so always safe to broadcast.

    Counts are combined on the map side, so a hot key moves one partial count per task.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("join_hot_key")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") > F.col("total") * share).select("join_hot_key")


def hot_list(counts: DataFrame, key: str, total: int, share: float = HOT_SHARE, least: int = HOT_LEAST) -> list:
    """Keys of ``counts`` (key, n) with more than ``share`` of ``total`` rows and more than ``least``: ``1 / share`` values at most.

    No key can be hot in a table of ``least`` rows, so none is looked for there.
    """
    if total <= least:
        return []
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("n") > max(total * share, least))).select(key).collect()]


def many_to_one(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", salt: int = 16, hot: list | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per ``key``) with the hot keys of ``rows`` spread over ``salt`` tasks.

    Only the lookup rows of hot keys are replicated (at most ``salt / HOT_SHARE`` rows), all others travel once.
    ``how`` is inner or left. A null key finds no partner. Salts follow the row's content, so a retried task gives the same rows.
    ``hot`` names the hot keys where the caller knows them; otherwise they are counted first.
    """
    others = [c for c in rows.columns if c != key]
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in others]), F.lit(salt)).cast("int") if others else F.lit(0)
    every = F.sequence(F.lit(0), F.lit(salt - 1))
    if hot is not None:
        if not hot:
            return rows.join(lookup, key, how)
        left = rows.withColumn("join_salt", F.when(F.col(key).isin(hot), spread).otherwise(F.lit(0)))
        right = lookup.withColumn("join_salt", F.explode(F.when(F.col(key).isin(hot), every).otherwise(F.array(F.lit(0)))))
        return left.join(right, [key, "join_salt"], how).drop("join_salt")
    known = F.broadcast(join_hot_keys(rows, key))
    left = rows.join(known, F.col(key) == F.col("join_hot_key"), "left").withColumn(
        "join_salt", F.when(F.col("join_hot_key").isNotNull(), spread).otherwise(F.lit(0))
    ).drop("join_hot_key")
    right = lookup.join(known, F.col(key) == F.col("join_hot_key"), "left").withColumn(
        "join_salt", F.explode(F.when(F.col("join_hot_key").isNotNull(), every).otherwise(F.array(F.lit(0))))
    ).drop("join_hot_key")
    return left.join(right, [key, "join_salt"], how).drop("join_salt")
