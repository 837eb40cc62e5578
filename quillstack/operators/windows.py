"""Ordered computations. Global orders are cut by day, so that no window holds the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def following(items: DataFrame, key: str = "id", at: str = "created_at") -> DataFrame:
    """(key, at, next_id, next_at): the next item in time, ties by key; items without time are left out.

    Within an hour by a window; the last item of an hour takes the first of the next hour that has any, found over one row per calendar hour.
    """
    rows = items.where(F.col(at).isNotNull()).select(F.col(key).alias("id"), F.col(at).alias("at"), F.date_trunc("hour", F.col(at).cast("timestamp")).alias("hour"))
    by_hour = Window.partitionBy("hour").orderBy("at", "id")
    rows = rows.withColumn("next_id", F.lead("id").over(by_hour)).withColumn("next_at", F.lead("at").over(by_hour))
    firsts = rows.groupBy("hour").agg(F.min(F.struct("at", "id")).alias("first"))
    firsts = firsts.select("hour", F.lead("first").over(Window.orderBy("hour")).alias("head"))  # a row per calendar hour
    whole = rows.join(firsts, "hour")
    last = F.col("next_id").isNull()
    return whole.select("id", "at", F.when(last, F.col("head.id")).otherwise(F.col("next_id")).alias("next_id"), F.when(last, F.col("head.at")).otherwise(F.col("next_at")).alias("next_at"))


def within_seconds(items: DataFrame, at: str, seconds: int = DAY) -> DataFrame:
    """(at_second, n, later): items per second and the number of items in the following ``seconds`` (up to a day), that second's others included.

    Counts per second come first, so a window holds at most two days of seconds, whatever their load.
    """
    if not 0 < seconds <= DAY:
        raise ValueError("seconds must be within a day")
    per = items.where(F.col(at).isNotNull()).groupBy(F.unix_seconds(F.col(at).cast("timestamp")).alias("at_second")).agg(F.count(F.lit(1)).alias("n"))
    day = F.floor(F.col("at_second") / DAY)
    twice = per.select("at_second", "n", F.explode(F.array(F.struct(day.alias("bucket"), F.lit(True).alias("own")), F.struct((day - 1).alias("bucket"), F.lit(False).alias("own")))).alias("b"))
    span = Window.partitionBy("b.bucket").orderBy("at_second").rangeBetween(0, seconds)
    return twice.withColumn("later", F.sum("n").over(span) - 1).where("b.own").select("at_second", "n", "later")


def runs(items: DataFrame, by: str, at: str, gap_days: int) -> DataFrame:
    """(by, run, n, first_at, last_at): stretches of a group's items without a gap of more than ``gap_days`` days.

    Items are counted per day first, so a window holds one row per calendar day of a group, whatever its load.
    """
    days = items.where(F.col(at).isNotNull() & F.col(by).isNotNull()).groupBy(by, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    order = Window.partitionBy(by).orderBy("day")
    fresh = F.coalesce((F.datediff(F.col("day"), F.lag("day").over(order)) > gap_days).cast("int"), F.lit(0))
    rows = days.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return rows.groupBy(by, "run").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def _places(rows: DataFrame, by: list[str], at: str, order: list[Column]) -> DataFrame:
    """Rows with ``place``: their number in time within the groups ``by``, ties by ``order``; those without time come first.

    Rows are numbered within an hour by a window; a running sum over one row per group and hour gives what lies before it.
    """
    hour = F.coalesce(F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / 3600), F.lit(-(1 << 62)))
    rows = rows.withColumn("place_hour", hour)
    per = rows.groupBy(*by, "place_hour").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("place_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*by, "place_hour").orderBy(F.asc_nulls_first(at), *order))
    named = before.select(*[F.col(c).alias("group_" + c) for c in by], F.col("place_hour").alias("group_hour"), "before")
    same = [rows[c].eqNullSafe(named["group_" + c]) for c in by] + [rows["place_hour"] == named["group_hour"]]
    joined = rows.withColumn("within", within).join(named, same)
    return joined.withColumn("place", F.col("within") + F.col("before")).drop("place_hour", "within", "before", "group_hour", *["group_" + c for c in by])


def ranked_in_time(rows: DataFrame, at: str, ties: list[str], name: str) -> DataFrame:
    """Rows with a running number ``name`` in order of ``at`` and ``ties``, which together must be unique, without a window over the whole table."""
    return _places(rows.withColumn("place_year", F.lit(0)), ["place_year"], at, [F.col(c) for c in ties]).withColumnRenamed("place", name).drop("place_year")


def numbered(rows: DataFrame, at: str, ties: list[str], prefix: str = "EID") -> DataFrame:
    """Rows with an identifier PREFIX-year-number: numbered within the year of ``at`` in order of time and ``ties``, at least four figures."""
    n = F.col("place")
    out = _places(rows.withColumn("place_year", F.year(at)), ["place_year"], at, [F.col(c) for c in ties])
    eid = F.concat(F.lit(prefix + "-"), F.col("place_year").cast("string"), F.lit("-"), F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))
    return out.withColumn("eid", eid).drop("place", "place_year")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``. Only one row a key and task travels."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, "row.*")
