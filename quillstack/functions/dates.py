"""Date expressions. The present is always a parameter, so results do not change from day to day."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The day that stands for today in the queries.
AS_OF = datetime(2026, 1, 1)


def relative_date(text: str, as_of: datetime = AS_OF) -> datetime | None:
    """Midnight that words such as 'yesterday', 'last week' or '3 days ago' name, or None."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    words = text.lower().strip().split()
    if len(words) == 1 and words[0] in ("today", "yesterday", "tomorrow"):
        return day + timedelta(days={"today": 0, "yesterday": -1, "tomorrow": 1}[words[0]])
    if len(words) == 2 and words[0] in ("this", "last") and words[1] in ("week", "month", "year"):
        back = words[0] == "last"
        if words[1] == "week":
            return day - timedelta(days=day.weekday() + 7 * back)
        if words[1] == "year":
            return day.replace(year=day.year - back, month=1, day=1)
        first = day.replace(day=1)
        return (first - timedelta(days=1)).replace(day=1) if back else first
    if len(words) == 3 and words[2] == "ago" and words[0].isdigit():
        unit = {"day": 1, "week": 7, "month": 30, "year": 365}.get(words[1].rstrip("s"))
        return day - timedelta(days=int(words[0]) * unit) if unit else None
    return None


def window_start(text: str, as_of: datetime = AS_OF) -> datetime:
    """Start of a window written as 30m, 24h or 7d."""
    unit = {"m": "minutes", "h": "hours", "d": "days"}[text[-1]]
    return as_of - timedelta(**{unit: int(text[:-1])})


def parsed_date(c: Column) -> Column:
    """The first reading that is a date: year first, then month/day, then day.month, then with month names."""
    def at(pattern: str, form: str) -> Column:
        return F.try_to_timestamp(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.lit(form)).cast("date")

    return F.coalesce(at(r"\b(\d{4}-\d{2}-\d{2})\b", "yyyy-MM-dd"), at(r"\b(\d{1,2}/\d{1,2}/\d{4})\b", "M/d/yyyy"), at(r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b", "d.M.yyyy"))


def date_kind(context: Column) -> Column:
    """What a date is about, by the first cue found in its context."""
    low = F.lower(context)
    return F.when(low.contains("filed"), "filing").when(low.contains("hearing"), "hearing").when(low.contains("served"), "service").when(low.contains("due") | low.contains("deadline"), "deadline").otherwise("event")


def closeness(days: Column) -> Column:
    """Strength of a link by its distance in days."""
    return F.when(days < 1, 1.0).when(days < 7, 0.7).when(days < 30, 0.5).when(days < 365, 0.3).otherwise(0.1)


def recency(c: Column, as_of: datetime = AS_OF) -> Column:
    """exp(-days / 30) within 0..1; 0.5 for unknown times."""
    days = F.datediff(F.lit(as_of), c)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-days / 30.0))), F.lit(0.5))
