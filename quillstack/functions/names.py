"""Column expressions on names of files, citations, typed dates, snippets and paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of dates in file names with the places of year, month and day.
NAME_DATES = [
    (r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)), (r"(\d{4})_(\d{2})_(\d{2})", (1, 2, 3)), (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    (r"(\d{2})-(\d{2})-(\d{4})", (3, 1, 2)), (r"(\d{2})_(\d{2})_(\d{4})", (3, 1, 2)), (r"(\d{2})/(\d{2})/(\d{4})", (3, 1, 2)),
]
# Forms of a date typed as a filter, in the order they are tried.
FILTER_FORMS = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MM-dd-yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_in_name(c: str | Column) -> Column:
    """Date in a file name by the first pattern that gives one between 1900 and 2100; null without."""
    found = []
    for pattern, places in NAME_DATES:
        day = F.try_to_date(F.concat_ws("-", *[F.nullif(F.regexp_extract(_col(c), pattern, p), F.lit("")) for p in places]), "yyyy-MM-dd")
        found.append(F.when(F.year(day).between(1900, 2100), day))
    return F.coalesce(*found)


def date_prefix(c: str | Column) -> Column:
    """Date that a file name begins with, before an underscore."""
    return F.try_to_date(F.nullif(F.regexp_extract(_col(c), r"^(\d{4}-\d{2}-\d{2})_", 1), F.lit("")), "yyyy-MM-dd")


def stem_characters(c: str | Column) -> Column:
    """Distinct characters of a file name without its last ending, sorted."""
    return F.array_sort(F.array_distinct(F.split(F.lower(F.regexp_replace(_col(c), r"\.[^.]*$", "")), "")))


def name_faults(c: str | Column) -> Column:
    """What is wrong with a file name on any usual system, as an array; an empty array for a good name."""
    n = _col(c)
    stem = F.upper(F.regexp_extract(n, r"^[^.]*", 0))
    return F.filter(F.array(
        F.when(n == "", "empty"), F.when(n.rlike(r'[<>:"/\\|?*]'), "reserved_character"), F.when(stem.rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), "reserved_name"),
        F.when(n.rlike("[. ]$"), "ends_badly"), F.when(F.length(n) > 255, "too_long")), lambda x: x.isNotNull())


def snippet_score(c: str | Column, terms: list[str]) -> Column:
    """Share of ``terms`` among the words, raised by a tenth of how early each stands, lowered in proportion beyond 200 characters. Empty: null."""
    low, n = F.lower(_col(c)), F.length(_col(c))
    words = F.split(F.trim(low, F.lit("\n\r\t ")), r"[ \t\n\r\f]+")
    hits = reduce(lambda x, y: x + y, [F.array_contains(words, t).cast("int") for t in terms])
    early = reduce(lambda x, y: x + y, [F.when(F.locate(t, low) > 0, (1.0 - (F.locate(t, low) - 1) / n) * 0.1).otherwise(0.0) for t in terms])
    return hits / len(terms) * (1.0 + early) * F.least(F.lit(1.0), F.lit(200.0) / n)


def statute_key(c: str | Column) -> Column:
    """Citation of a law with single blanks and the usual capitals."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"\s+", " "), r"(?i)u\.?s\.?c\.?", "USC"), "(?i)cfr", "CFR")


def date_filter(c: str | Column) -> Column:
    """Time of a date typed as a filter, by the first form that fits the whole text; null without."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(_col(c)), F.lit(f)).cast("timestamp_ntz") for f in FILTER_FORMS])


def paragraphs_of(c: str | Column) -> Column:
    """Trimmed stretches between blank lines that are not empty."""
    return F.filter(F.transform(F.split(_col(c), "\n\n"), lambda p: F.trim(p, F.lit("\n\r\t "))), lambda p: p != "")


def mail_search(query: str) -> Column:
    """Predicate on mails (sender, recipient_to, subject, content, datetime_utc) for a search string.

    from:, to: and subject: ask for a part of the field, after: and before: for a day (yyyy/mm/dd), other words for a part of subject or content;
    all must hold. A null field holds nothing. An empty string admits every mail.
    """
    has = lambda c, w: F.coalesce(F.contains(F.lower(c), F.lit(w.lower())), F.lit(False))
    every = F.lit(True)
    for part in query.split():
        key, _, value = part.partition(":")
        if key in ("from", "to", "subject") and value:
            every = every & has({"from": "sender", "to": "recipient_to", "subject": "subject"}[key], value)
        elif key in ("after", "before") and value:
            day = F.lit(value.replace("/", "-")).cast("timestamp_ntz")
            every = every & (F.col("datetime_utc") >= day if key == "after" else F.col("datetime_utc") < day)
        else:
            every = every & (has("subject", part) | has("content", part))
    return every
