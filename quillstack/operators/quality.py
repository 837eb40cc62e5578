"""Quality of extracted text by six measured gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import share_of

# Gates and weights of the score.
GATES = {"few_letters": 0.6, "many_figures": 0.3, "many_symbols": 0.05, "few_words": 20, "few_chars": 200}
COMMON = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "was", "on", "with", "as", "by", "at", "be", "or", "from", "this", "not"]


def measures(text: str = "text") -> dict[str, Column]:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(COMMON)))
    return {
        "letters": F.round(share_of(text, "[A-Za-z]"), 8), "figures": F.round(share_of(text, "[0-9.,;:]"), 8), "symbols": F.round(share_of(text, r"[^A-Za-z0-9\s.,;:!?'\"()/$%&@-]"), 8),
        "n_words": F.size(words).cast("long"), "common": F.round(F.coalesce(F.try_divide(hits.cast("double"), F.size(words)), F.lit(0.0)), 8), "n_chars": F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
    }


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the measures, a score in 0..1, its class and the reasons, sorted. Null texts are empty texts."""
    rows = docs.withColumns(measures(text))
    score = (
        0.3 * F.least(F.lit(1.0), F.col("letters") / 0.8) + 0.2 * (1 - F.least(F.lit(1.0), F.col("figures") / 0.3)) + 0.2 * (1 - F.least(F.lit(1.0), F.col("symbols") / 0.05))
        + 0.2 * F.least(F.lit(1.0), F.col("common") / 0.3) + 0.1 * F.least(F.lit(1.0), F.col("n_chars") / 500.0)
    )
    reasons = F.filter(F.array(
        F.when(F.col("letters") < GATES["few_letters"], "few_letters"), F.when(F.col("figures") > GATES["many_figures"], "many_figures"), F.when(F.col("symbols") > GATES["many_symbols"], "many_symbols"),
        F.when(F.col("n_words") < GATES["few_words"], "few_words"), F.when(F.col("n_chars") < GATES["few_chars"], "few_chars")), lambda r: r.isNotNull())
    out = rows.withColumn("score", F.round(score, 6)).withColumn("reasons", F.array_join(F.array_sort(reasons), ","))
    return out.withColumn("status", F.when(F.col("n_chars") == 0, "EMPTY").when(F.col("score") >= 0.7, "PASS").when(F.col("score") >= 0.5, "BORDERLINE").otherwise("FAIL"))


# Limits of the six gates and weights of the parts.
LIMITS = {"n_chars": 1500, "per_page": 300, "alpha": 0.55, "noise": 0.35, "symbols": 0.15, "bigrams": 200, "hits": 0.35}
WEIGHTS = {"alpha": 0.25, "noise": 0.15, "symbols": 0.15, "bigrams": 0.15, "hits": 0.20, "per_page": 0.10}


def gated(docs: DataFrame, text: str = "text", dictionary: list[str] | None = None, pages: Column | None = None) -> DataFrame:
    """Documents with n_chars, bigrams (distinct pairs of neighbouring letters), hits (share of words in ``dictionary``), a weighted score and
    the gates that fail, in order. ``pages`` is the number of pages, 1 without. Null and blank texts have score 0 and the reason empty_text."""
    c, n = F.coalesce(F.col(text), F.lit("")), F.length(F.coalesce(F.col(text), F.lit("")))
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    rows = docs.withColumns({
        "n_chars": n.cast("long"), "alpha": share_of(text, "[A-Za-z]"), "noise": share_of(text, r"[0-9.,;:!?()\[\]{}\"'-]"), "symbols": share_of(text, r"[&=%£€<>©#@$*+^~|\\]"),
        "bigrams": F.size(F.array_distinct(F.regexp_extract_all(F.regexp_replace(low, r"\s+", " "), F.lit("(?=([a-z]{2}))"), F.lit(1)))).cast("long"),
        "hits": F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: w.isin(dictionary or COMMON))).cast("double"), F.size(words)), F.lit(0.0)),
        "per_page": n / (F.greatest(pages, F.lit(1)) if pages is not None else F.lit(1)),
    })
    one, part = F.lit(1.0), {}
    for k in ("alpha", "bigrams", "hits", "per_page"):
        part[k] = F.least(F.col(k) / F.lit(float(LIMITS[k])), one)
    for k in ("noise", "symbols"):
        part[k] = F.greatest(F.lit(0.0), 1 - F.col(k) / F.lit(LIMITS[k]))
    score = part["alpha"] * WEIGHTS["alpha"]
    for k in ("noise", "symbols", "bigrams", "hits", "per_page"):
        score = score + part[k] * WEIGHTS[k]
    blank = F.length(F.trim(c)) == 0
    reasons = F.filter(F.array(
        F.when((F.col("n_chars") < LIMITS["n_chars"]) & (F.col("per_page") < LIMITS["per_page"]), "insufficient_content"), F.when(F.col("alpha") < LIMITS["alpha"], "low_alpha_ratio"), F.when(F.col("noise") > LIMITS["noise"], "high_noise_ratio"),
        F.when(F.col("symbols") > LIMITS["symbols"], "high_symbol_ratio"), F.when(F.col("bigrams") < LIMITS["bigrams"], "low_bigram_diversity"), F.when(F.col("hits") < LIMITS["hits"], "low_english_hits")), lambda r: r.isNotNull())
    return rows.withColumn("score", F.when(blank, 0.0).otherwise(F.round(score, 3))).withColumn("reasons", F.when(blank, "empty_text").otherwise(F.array_join(reasons, ",")))
