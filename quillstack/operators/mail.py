"""Mail messages: flattening raw records, replies, conversation chains, chunks of long texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = "id string, threadId string, payload struct<headers: array<struct<name: string, value: string>>, body: struct<data: string>, parts: array<struct<mimeType: string, filename: string, body: struct<data: string, size: int>>>>"


def header(name: str) -> Column:
    """First value of a header, whatever its case; null if it is missing."""
    found = F.filter("payload.headers", lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(found, F.lit(1))["value"]


def decoded(c: Column) -> Column:
    """URL-safe base64 to text; undecodable data is null."""
    raw = F.translate(c, "-_", "+/")
    return F.decode(F.try_to_binary(raw, F.lit("base64")), "UTF-8")


def parsed_messages(raw: DataFrame) -> DataFrame:
    """Flat records (id, thread_id, subject, sender, recipient_to, sent, body) of raw messages (schema RAW).

    The first plain text part is the body, else the first HTML part, else the message's own data. Unreadable dates are null.
    """
    part = lambda kind: F.try_element_at(F.filter("payload.parts", lambda p: p["mimeType"] == kind), F.lit(1))["body"]["data"]
    body = decoded(F.coalesce(part("text/plain"), part("text/html"), F.col("payload.body.data")))
    sent = F.regexp_extract(header("Date"), r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return raw.select(
        "id", F.col("threadId").alias("thread_id"), header("Subject").alias("subject"), header("From").alias("sender"), header("To").alias("recipient_to"),
        F.try_to_timestamp(F.nullif(sent, F.lit("")), F.lit("d MMM yyyy HH:mm:ss")).alias("sent"), body.alias("body"),
    )


def attachments(raw: DataFrame) -> DataFrame:
    """(id, filename, mime_type, size): named parts of raw messages."""
    return raw.select("id", F.explode("payload.parts").alias("p")).where("p.filename != ''").select("id", "p.filename", F.col("p.mimeType").alias("mime_type"), "p.body.size")


_STOP = r"^\s*(>|On .* wrote:\s*$|From: |-+ ?Original Message|-+ ?Forwarded message|Begin forwarded message)"


def reply_text(c: Column | str) -> Column:
    """Lines before the first quotation or boundary."""
    lines = F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(_STOP)), True)
    return F.array_join(F.when(at == 0, lines).when(at == 1, F.array().cast("array<string>")).otherwise(F.slice(lines, 1, F.greatest(at - 1, F.lit(1)).cast("int"))), "\n")


_CHAIN = "array<struct<depth int, sender string, text string>>"
_INTRO = re.compile(r"^\s*(?:On .{5,80}, (?P<a>.{2,80}?)(?: <[^>]+>)? wrote:|(?P<b>.{2,80}?) <[^>]+> wrote on .*:|From: (?P<c>.{2,80}?)(?: <[^>]+>)?)\s*$")


def conversation(docs: DataFrame) -> DataFrame:
    """(id, place, depth, sender, text): messages contained in a mail (id, text), the outermost first."""

    def chain(text: str | None) -> list[tuple]:
        out, depth, sender, lines = [], 0, None, []
        for line in (text or "").split("\n"):
            m = _INTRO.match(line.lstrip("> |:"))
            if m:
                out.append((depth, sender, "\n".join(lines).strip()))
                depth, sender, lines = depth + 1, m["a"] or m["b"] or m["c"], []
            else:
                lines.append(line.lstrip("> |").rstrip())
        out.append((depth, sender, "\n".join(lines).strip()))
        return [x for x in out if x[2]]

    @F.pandas_udf(_CHAIN)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(chain)

    return docs.select("id", F.posexplode(split("text")).alias("place", "m")).select("id", "place", "m.*")


def chunks(docs: DataFrame, size: int = 900, overlap: int = 100) -> DataFrame:
    """(id, place, start, chunk): pieces of at most ``size`` characters that overlap, ended at a sentence, paragraph or blank beyond the half.

    Null and empty texts have no pieces; together the pieces cover the text.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be under half of size")

    def cut(text: str | None) -> list[tuple[int, str]]:
        out, at = [], 0
        while text and at < len(text):
            end = min(len(text), at + size)
            if end < len(text):
                marks = [text.rfind(m, at + size // 2, end) for m in (". ", "\n\n", " ")]
                best = next((m for m in marks if m >= 0), -1)
                end = best + 1 if best >= 0 else end
            out.append((at, text[at:end]))
            if end == len(text):
                break
            at = max(at + 1, end - overlap)
        return out

    @F.pandas_udf("array<struct<start int, chunk string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return docs.select("id", F.posexplode(pieces("text")).alias("place", "p")).select("id", "place", "p.*")
