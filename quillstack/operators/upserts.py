"""Changes to tables as pure rewrites: each returns the table as it is afterwards. Parquet has no row-level changes.

``written`` puts a result down with an idempotent batch folder, so that a repeated attempt replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.dates import AS_OF
from quillstack.operators.windows import latest


def inserted(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and those ``rows`` whose key it lacks, the first of each by all columns. Null keys are always new."""
    fresh = rows.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return target.unionByName(fresh, allowMissingColumns=True)


def upserted(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with ``rows`` in place of rows of equal keys; of several new rows the last by all columns wins."""
    others = [c for c in target.columns if c not in keys]
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.select(*target.columns).withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.col("_new"), *[F.col(c) for c in others]]).select(*target.columns)


def updated(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on), on, "left_anti")


def insert_report(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(total, inserted, ignored) of an insert that ignores known keys."""
    total = rows.agg(F.count("*").alias("total"))
    new = rows.select(*keys).join(target.select(*keys), keys, "left_anti").distinct().agg(F.count("*").alias("inserted"))
    return total.crossJoin(new).select("total", "inserted", (F.col("total") - F.col("inserted")).alias("ignored"))


def retry_state(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Failed rows with the next attempt: 2 to the power of the attempts in minutes after processing, none from ``limit`` attempts on."""
    n = F.coalesce("attempt_count", F.lit(0))
    wait = F.make_dt_interval(mins=F.pow(F.lit(2), n).cast("int"))
    due = F.when(n >= limit, None).otherwise(F.col("processed_at") + wait)
    return rows.withColumn("due_at", due).withColumn("permanent", n >= limit)


def with_expiry(rows: DataFrame, created: str, hours: int, as_of=AS_OF) -> DataFrame:
    """Rows with their time of expiry and whether it has passed."""
    until = F.col(created) + F.make_dt_interval(hours=F.lit(hours))
    return rows.withColumn("expires_at", until).withColumn("expired", F.coalesce(until < F.lit(as_of), F.lit(False)))


def written(df: DataFrame, path: str, batch: int) -> None:
    """Put a batch down in its own folder, replacing what an earlier attempt of the same batch left."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
