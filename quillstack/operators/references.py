"""References to records that are missing, deleted or arrive late.

Parent and child keys are brought into one long table, tagged with their side, and grouped by reference and key;
groups lacking a parent, or whose parent comes late, name the orphan keys. All groupings combine on the map side, so a key
that holds a third of the rows moves a few partial rows only; the way back to the child rows is salted for hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.operators.skew import many_to_one

#: Length of a cut hash, which stands for every hash that begins so.
CUT = 16
#: A partner dated more than this after the row counts as late.
GRACE = "INTERVAL 24 HOURS"


def hash_key(c: Column) -> Column:
    """Hash without case and outer blanks; blank hashes are no reference."""
    k = F.lower(F.trim(c))
    return F.when(k != "", k)


def keyed(rows: DataFrame, ref_table: str, is_parent: bool, ref_id: Column, key: Column, at: Column, is_hash: bool) -> DataFrame:
    """One side of one reference in long form. ``stem`` groups a hash with its cut form, ``full`` is null for a cut one."""
    long = rows.select(
        F.lit(ref_table).alias("ref_table"), F.lit(is_parent).alias("is_parent"), ref_id.cast("string").alias("ref_id"), key.cast("string").alias("key"), at.alias("at")
    ).where(F.col("key").isNotNull())
    stem = F.substring("key", 1, CUT) if is_hash else F.col("key")
    full = F.when(F.length("key") > CUT, F.col("key")) if is_hash else F.col("key")
    return long.withColumn("stem", stem).withColumn("full", full)


def link_status(long: DataFrame) -> DataFrame:
    """One row per reference and key: number and earliest time of its partners, and whether a partner's time is unknown.

    A full hash has as partners equal hashes and its cut form; a cut hash has every hash with its stem.
    """
    parent = F.col("is_parent")
    keys = long.groupBy("ref_table", "stem", "full").agg(
        F.count_if(parent).alias("parents"),
        F.min(F.when(parent, F.col("at"))).alias("first_at"),
        F.count_if(parent & F.col("at").isNull()).alias("undated"),
        F.count_if(~parent).alias("children"),
    )
    group = Window.partitionBy("ref_table", "stem")
    cut = F.col("full").isNull()

    def both(own: str, combine, add) -> Column:
        everything = combine(own).over(group)
        from_cut = combine(F.when(cut, F.col(own))).over(group)
        return F.when(cut, everything).otherwise(add(F.col(own), from_cut))

    plus = lambda a, b: a + F.coalesce(b, F.lit(0))
    return keys.select(
        "ref_table", "stem", "full", "children",
        both("parents", F.sum, plus).alias("parents"),
        both("first_at", F.min, F.least).alias("first_at"),
        both("undated", F.sum, plus).alias("undated"),
    ).where("children > 0")


def orphans(sides: list[DataFrame]) -> DataFrame:
    """Child rows (ref_table, ref_id, at, reason) without a partner ('missing') or with a late one ('late').

    Null keys are no references. A null time of the row or of any partner counts as in time. Repeated rows give repeated rows.
    Empty tables give no rows, or make every reference to them missing.
    """
    long = reduce(DataFrame.unionByName, sides)
    status = link_status(long)
    doubtful = status.where("parents = 0 or undated = 0").select(
        F.concat_ws("\u0001", "ref_table", "stem", F.coalesce("full", F.lit(""))).alias("link"), "parents", "first_at"
    )
    rows = long.where(~F.col("is_parent")).select(
        "ref_table", "ref_id", "at", F.concat_ws("\u0001", "ref_table", "stem", F.coalesce("full", F.lit(""))).alias("link")
    )
    found = many_to_one(rows, doubtful, "link")
    late = (F.col("parents") > 0) & (F.col("first_at") > F.col("at") + F.expr(GRACE))
    return found.select(
        "ref_table", "ref_id", "at", F.when(F.col("parents") == 0, "missing").when(late, "late").alias("reason")
    ).where(F.col("reason").isNotNull())


def sides_of(chunks: DataFrame, content: DataFrame, embeddings: DataFrame) -> list[DataFrame]:
    """The project's three references in long form, each as its parent and its child side."""
    docs = content.where(F.col("source_type") == "document")
    chunk_key, content_key = hash_key(F.col("sha256")), hash_key(F.col("sha256"))
    return [
        keyed(chunks, "document_chunks", False, F.col("chunk_id"), chunk_key, F.col("processed_at"), True),
        keyed(docs, "document_chunks", True, F.col("id"), content_key, F.col("created_at"), True),
        keyed(docs, "content_unified", False, F.col("id"), content_key, F.col("created_at"), True),
        keyed(chunks, "content_unified", True, F.col("chunk_id"), chunk_key, F.col("processed_at"), True),
        keyed(embeddings, "content_embeddings", False, F.col("id"), F.col("content_id"), F.col("created_at"), False),
        keyed(content, "content_embeddings", True, F.col("id"), F.col("id"), F.col("created_at"), False),
    ]


def orphan_report(sides: list[DataFrame]) -> DataFrame:
    """Counts per referring table and month: references, missing and late ones. A row without time has a null month."""
    month = F.date_format("at", "yyyy-MM").alias("period")
    every = reduce(DataFrame.unionByName, sides).where(~F.col("is_parent")).groupBy("ref_table", month).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = orphans(sides).groupBy("ref_table", month).agg(
        F.count_if(F.col("reason") == "missing").alias("n_missing"), F.count_if(F.col("reason") == "late").alias("n_late")
    )
    return every.alias("e").join(
        bad.alias("b"), (F.col("e.ref_table") == F.col("b.ref_table")) & F.col("e.period").eqNullSafe(F.col("b.period")), "left"
    ).select("e.ref_table", "e.period", "n_refs", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("n_late", F.lit(0)).alias("n_late"))
