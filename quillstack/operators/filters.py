"""Predicates built from data, and keyword search. Everything compiles to Columns, so filters reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import any_has

_RANGE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def payload_filter(spec: dict) -> Column:
    """{field: value}, {field: [values]} and {field: {gt, gte, lt, lte}}, all of which must hold. An empty spec holds always."""
    parts = [F.lit(True)]
    for field, want in spec.items():
        c = F.col(field)
        if isinstance(want, dict):
            parts += [getattr(c, _RANGE[op])(v) for op, v in want.items()]
        else:
            parts.append(c.isin(list(want)) if isinstance(want, (list, tuple, set)) else c == want)
    return reduce(lambda a, b: a & b, parts)


def structured_filter(must: list[dict] = (), should: list[dict] = (), must_not: list[dict] = ()) -> Column:
    """All of ``must``, one of ``should`` if any are given, none of ``must_not`` (unknown counts as not matching)."""
    out = reduce(lambda a, b: a & b, [payload_filter(s) for s in must], F.lit(True))
    if should:
        out = out & reduce(lambda a, b: a | b, [payload_filter(s) for s in should])
    return reduce(lambda a, b: a & ~F.coalesce(b, F.lit(False)), [payload_filter(s) for s in must_not], out)


def keyword_search(content: DataFrame, words: list[str], types: list[str] | None = None, since=None, until=None, tags: list[str] = (), every_tag: bool = True, limit: int | None = 50) -> DataFrame:
    """Rows whose title or body holds one of ``words`` (no words: all rows), newest first, ties by id.

    ``types``, the half-open time range and ``tags`` (all or any, looked for in title and body) narrow the result. Words are taken literally.
    """
    cond = any_has(["title", "body"], list(words)) if words else F.lit(True)
    if types:
        cond &= F.col("source_type").isin(types)
    if since is not None:
        cond &= F.col("created_at") >= F.lit(since)
    if until is not None:
        cond &= F.col("created_at") < F.lit(until)
    if tags:
        each = [any_has(["title", "body"], [t]) for t in tags]
        cond &= reduce((lambda a, b: a & b) if every_tag else (lambda a, b: a | b), each)
    found = content.where(cond).orderBy(F.desc_nulls_last("created_at"), "id")
    return found.limit(limit) if limit else found


#: Why an extracted entity is not worth keeping, in the order of the tests.
NOISE = [
    ("weekday", r"(?i)^(mon|tues|wednes|thurs|fri|satur|sun)day$"), ("markup", r"</?[a-z]+|&[a-z]+;"), ("symbols", r"[^\sA-Za-z0-9]{3,}"), ("repeat", r"(?i)(aaa|bbb|ccc|ddd|eee|iii|lll|mmm|nnn|ooo|rrr|sss|ttt|xxx|zzz)"),
    ("figures", r"^[0-9 .,/-]+$"), ("breaks", r"[\n\r\t]"),
]


def noise_of(c: Column) -> Column:
    """The first reason to drop an entity text, or null: too short, too long, or one of NOISE."""
    out = F.when(F.length(F.trim(c)) < 2, "short").when(F.length(c) > 100, "long")
    for name, pattern in NOISE:
        out = out.when(c.rlike(pattern), name)
    return out
