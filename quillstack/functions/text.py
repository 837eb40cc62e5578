"""String expressions: cleaning, hashing, identifiers and headers. All are Column to Column and stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Text) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"[ \t\n\r\f]+", " "))


def has(c: Text, word: str) -> Column:
    """Case-insensitive containment; blank words are in every text, null texts hold nothing."""
    return F.contains(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(word.lower()))


def any_has(cs: list[Text], words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [has(c, w) for c in cs for w in words])


def clean_text(c: Text, longest: int | None = None) -> Column:
    """Without zero-width characters, squeezed, and cut to ``longest`` characters with dots."""
    s = squeeze(F.regexp_replace(col(c), "[​‌‍﻿]", ""))
    return s if longest is None else F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest), F.lit("..."))).otherwise(s)


def header_address(c: Text) -> Column:
    """Address of a header: what stands in angle brackets, else the trimmed whole."""
    inner = F.regexp_extract(col(c), r"<([^<>]+)>", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(col(c))))


def mail_domain(c: Text) -> Column:
    return F.lower(F.split_part(col(c), F.lit("@"), F.lit(2)))


def address_fault(c: Text) -> Column:
    """Why an address is not valid, or null."""
    s = col(c)
    return (
        F.when(s.isNull() | (F.trim(s) == ""), "empty").when(F.length(s) > 320, "too long").when(~F.contains(s, F.lit("@")), "no at sign")
        .when(~s.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), "malformed")
    )


def addresses_in(c: Text) -> Column:
    """All addresses of a text in small letters, sorted, each once."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def body_hash(c: Text) -> Column:
    """SHA-256 of the squeezed small-letter text."""
    return F.sha2(squeeze(F.lower(col(c))), 256)


def content_hash(*parts: Column) -> Column:
    """SHA-256 of parts joined by a bar; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def pair_key(a: Text, b: Text) -> Column:
    """Key of an unordered pair of ids."""
    return F.md5(F.concat_ws("||", F.least(col(a), col(b)), F.greatest(col(a), col(b))))


def short_id(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, length)


def uuid5(c: Text, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (version 5) of a string, as a pure expression; the default namespace is that of domain names."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(col(c), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def slug(c: Text, longest: int | None = None) -> Column:
    """Small letters, figures and single hyphens; other characters are dropped."""
    s = F.regexp_replace(F.lower(F.trim(col(c))), r"[\s_]+", "-")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9-]", ""), "-+", "-"), "^-|-$", "")
    return s if longest is None else F.regexp_replace(F.substring(s, 1, longest), "-$", "")


def safe_filename(c: Text, longest: int = 100) -> Column:
    s = F.regexp_replace(F.regexp_replace(col(c), r'[<>:"/\\|?*]', "_"), "[ _]+", "_")
    return F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest - 3), F.lit("..."))).otherwise(s)


def short_filename(c: Text, longest: int) -> Column:
    """Stem cut so that stem and extension fit."""
    ext = F.regexp_extract(col(c), r"(\.[A-Za-z0-9]{1,5})$", 1)
    stem = F.substring(col(c), F.lit(1), F.length(col(c)) - F.length(ext))
    return F.concat(F.substring(stem, F.lit(1), F.lit(longest) - F.length(ext)), ext)


def letter_jaccard(a: Text, b: Text) -> Column:
    """Share of characters two strings have in common, as sets."""
    x, y = (F.array_distinct(F.split(F.lower(col(c)), "")) for c in (a, b))
    x, y = (F.filter(v, lambda e: e != "") for v in (x, y))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def word_set(c: Text) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9]+"), lambda w: w != ""))


def word_jaccard(a: Text, b: Text) -> Column:
    x, y = word_set(a), word_set(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def bare_subject(c: Text) -> Column:
    """Subject without reply and forward marks and bracketed tags, each taken off once in order."""
    s = F.trim(F.coalesce(col(c), F.lit("")))
    for p in (r"(?i)^re:\s*", r"(?i)^fwd:\s*", r"(?i)^fw:\s*", r"(?i)^reply:\s*", r"^\[[^\]]*\]\s*"):
        s = F.regexp_replace(s, p, "")
    return F.lower(F.trim(s))


def is_reply(c: Text) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit("")))).rlike(r"^(re|reply|response):")


#: Phrases that only automatic mail has.
AUTOMATED = ["do not reply", "automated", "auto-reply", "out of office", "no-reply", "noreply", "unsubscribe"]


def is_automated(subject: Text, sender: Text, body: Text) -> Column:
    return any_has([subject, sender, body], AUTOMATED)


def without_markup(c: Text) -> Column:
    """HTML to text: scripts and styles dropped, blocks become line ends, tags go, common entities are resolved."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<(br|/p|/div|/tr|/h[1-6])[^>]*>", "\n"), r"(?i)<li[^>]*>", "- ")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(s)


def few_breaks(c: Text) -> Column:
    """CRLF to LF, no NUL, lines without trailing blanks, at most one blank line in a row."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r\n?", "\n"), "\\x00", "")
    return F.regexp_replace(F.regexp_replace(s, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def without_markdown(c: Text) -> Column:
    """Markdown to text, by rules in order: fences, headings, images, links, emphasis, bullets."""
    s = F.coalesce(col(c), F.lit(""))
    for p, r in (("(?s)```.*?```", ""), ("(?m)^#{1,6} +", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", "$1"), ("(?m)^[-*+] +", "")):
        s = F.regexp_replace(s, p, r)
    return F.trim(s)


def share_of(c: Text, pattern: str) -> Column:
    """Share of characters that match a one-character pattern; empty texts have 0."""
    s = F.coalesce(col(c), F.lit(""))
    return F.coalesce(F.try_divide(F.regexp_count(s, F.lit(pattern)).cast("double"), F.length(s)), F.lit(0.0))


#: Legal forms that firm names end in.
FIRM_ENDS = r"\b(inc|incorporated|corp|corporation|llc|llp|pllc|ltd|limited|co|company)\b\.?"


def firm_key(c: Text) -> Column:
    s = F.regexp_replace(F.lower(col(c)), FIRM_ENDS, "")
    return squeeze(F.regexp_replace(s, r"[^a-z0-9& ]+", " "))


def case_numbers(c: Text) -> Column:
    """Docket numbers such as 2020-CA-123456, upper case, sorted, each once."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\b(\d{4}-[A-Z]{2}-\d{4,7})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def text_key(c: Text) -> Column:
    """Form under which repeated passages meet: squeezed small letters, figures as one mark."""
    return F.regexp_replace(squeeze(F.lower(col(c))), r"\d+", "[NUM]")


def snippet(c: Text, term: str, width: int = 150) -> Column:
    """Squeezed stretch of ``width`` characters around the first place of ``term``, with dots where text was cut."""
    s = squeeze(F.coalesce(col(c), F.lit("")))
    at = F.locate(term.lower(), F.lower(s))
    lo = F.greatest(F.lit(1), at - width // 2)
    part = F.substring(s, lo, F.lit(width))
    return F.when(F.length(s) <= width, s).otherwise(F.concat(F.when(lo > 1, "...").otherwise(""), F.trim(part), F.when(lo + width - 1 < F.length(s), "...").otherwise("")))


def highlighted(c: Text, term: str) -> Column:
    return F.regexp_replace(col(c), rf"(?i)\b({term})\b", "[$1]")
