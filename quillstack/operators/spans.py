"""Pattern spans with offsets: entities, boilerplate and protected passages, and what to do about overlaps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What the extractors look for. Kind, confidence, pattern.
ENTITY_PATTERNS = [
    ("case_number", 0.9, r"\b\d{4}-[A-Z]{2}-\d{4,7}\b"), ("case_number", 0.9, r"\bCase No\. ?\S+"), ("court", 0.85, r"(?i)\b(?:circuit|county|district|superior|supreme|appellate|probate|small claims) (?:court|clerk|panel|registry|desk)\b"),
    ("statute", 0.9, r"\b\d+ U\.?S\.?C\.? ?§? ?\d+\b"), ("statute", 0.9, r"\bSec\. \d+(?:\.\d+)*(?:\(\d+\))?"), ("money", 0.8, r"\$\d{1,3}(?:,\d{3})*(?:\.\d\d)?"), ("date", 0.8, r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b"),
]
BOILERPLATE_PATTERNS = [
    ("reservation", 0.9, r"(?i)nothing herein shall be construed[^.\n]*\."), ("certificate", 0.9, r"(?i)the undersigned certifies[^.\n]*\."), ("incorporation", 0.9, r"(?i)paragraph \d+ of [^.\n]* is incorporated here by reference\."),
    ("objection", 0.9, r"(?i)[^.\n]*reserves all objections[^.\n]*\."), ("confidential", 0.9, r"(?i)this (?:e-?mail|message)[^.\n]*confidential[^.\n]*\."),
]
PROTECTED = r"(?i)\$\d|deadline|must be filed|hearing on|judgment"

_SPAN = "array<struct<kind string, confidence double, start int, end int, text string>>"


def find_spans(docs: DataFrame, patterns: list[tuple[str, float, str]]) -> DataFrame:
    """(id, kind, confidence, start, end, text) of documents (id, text): every match of every pattern; null texts have none."""
    rules = [(k, c, p) for k, c, p in patterns]

    @F.pandas_udf(_SPAN)
    def scan(texts: pd.Series) -> pd.Series:
        ready = [(k, c, re.compile(p)) for k, c, p in rules]
        return pd.Series([[(k, c, m.start(), m.end(), m[0]) for k, c, p in ready for m in p.finditer(t)] if t else [] for t in texts])

    return docs.select("id", F.explode(scan("text")).alias("s")).select("id", "s.*")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Spans of a document, the surer (then longer, then earlier) first, without those that overlap a kept one by half of the shorter."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(size=group["start"] - group["end"]).sort_values(["confidence", "size", "start", "kind"], ascending=[False, True, True, True])
        kept: list[tuple[int, int]] = []
        good = []
        for a, b in zip(group["start"], group["end"]):
            ok = all(2 * (min(b, d) - max(a, c)) < min(b - a, d - c) for c, d in kept)
            good.append(ok)
            if ok:
                kept.append((a, b))
        return group[good].drop(columns="size")

    return spans.groupBy("id").applyInPandas(keep, spans.schema)


def merged(spans: DataFrame) -> DataFrame:
    """(id, start, end): union of each document's intervals, by one ordered pass."""
    w = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.select("id", "start", "end").withColumn("fresh", (F.col("start") > F.coalesce(F.max("end").over(w), F.lit(-1))).cast("int"))
    rows = rows.withColumn("island", F.sum("fresh").over(Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def removed(docs: DataFrame, spans: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, text, n_removed): texts without the sure spans of at least 20 characters that hold nothing protected."""
    safe = spans.where((F.col("confidence") >= least) & (F.col("end") - F.col("start") >= 20) & ~F.col("text").rlike(PROTECTED))
    cuts = merged(safe).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, cs in zip(texts, cuts):
            if t is not None and cs is not None:
                for c in reversed(list(cs)):
                    t = t[: c["start"]] + t[c["end"] :]
                t = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", t)).strip()
            out.append(t)
        return pd.Series(out)

    return docs.join(cuts, "id", "left").select("id", cut("text", "cuts").alias("text"), F.coalesce(F.size("cuts"), F.lit(0)).alias("n_removed"))


def repeated_passages(docs: DataFrame, least: int = 2, share: float = 0.01) -> DataFrame:
    """(passage, n_docs, n, confidence): paragraphs of over 20 characters, figures apart, in at least max(least, share) documents."""
    from quillstack.functions.text import text_key

    parts = docs.select("id", F.explode(F.split("text", "\n\n")).alias("p")).where(F.length(F.trim("p")) > 20)
    keys = parts.select("id", text_key("p").alias("passage")).groupBy("passage", "id").agg(F.count("*").alias("k"))
    counts = keys.groupBy("passage").agg(F.count("*").alias("n_docs"), F.sum("k").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    kept = counts.crossJoin(F.broadcast(total)).where((F.col("n_docs") >= least) & (F.col("n_docs") >= F.col("total") * share))
    return kept.select("passage", "n_docs", "n", F.round(F.least(F.lit(0.95), 0.5 + F.col("n_docs") / F.col("total")), 8).alias("confidence"))
