"""Files as tables: text, markdown, word documents and what else a folder holds. Contents are read by the executors."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of all files below ``folder`` whose name matches."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def with_format(df: DataFrame) -> DataFrame:
    """Files with their format: by the first bytes, else by the extension, else text if the first kilobyte is printable UTF-8, else null."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))

    @F.pandas_udf("boolean")
    def printable(parts: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> bool:
            if not b:
                return False
            text = b[:1024].decode("utf-8", "ignore")
            return len(text.encode()) > 0.9 * len(b[:1024]) and sum(c.isprintable() or c in "\n\r\t" for c in text) > 0.8 * len(text)

        return parts.map(one)

    kind = F.when(head == "25504446", "pdf").when((head == "504B0304") & (ext == "docx"), "docx").when(head == "504B0304", "zip").when(ext.isin("md", "markdown"), "markdown").when(ext.isin("html", "htm"), "html").when(ext.isin("txt", "csv", "log"), "text")
    return df.withColumn("format", F.coalesce(kind, F.when(printable(F.substring("content", 1, 1024)), "text")))


def docx_text(content: bytes | None) -> str | None:
    """Paragraphs and table rows of a word document; damaged files give null."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            out.append(said(e))
        elif e.tag == f"{w}tbl":
            out += [" | ".join(said(c) for c in r.iter(f"{w}tc")) for r in e.iter(f"{w}tr")]
    return "\n".join(x for x in out if x.strip())


def plain_text(content: bytes | None) -> str | None:
    """UTF-8, else Latin-1; line ends are unified."""
    if content is None:
        return None
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return re.sub(r"\r\n?", "\n", text).replace("\x00", "")


def texts(df: DataFrame) -> DataFrame:
    """(path, format, text, sha256): readable files as text. Formats without a reader here (pdf, zip) have null text."""

    @F.pandas_udf("string")
    def read(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([docx_text(c) if k == "docx" else plain_text(c) if k in ("text", "markdown", "html") else None for k, c in zip(kinds, contents)], dtype=object)

    return with_format(df).select("path", "format", read("format", "content").alias("text"), F.sha2("content", 256).alias("sha256"))


def front_matter(c: str = "text") -> tuple:
    """(front matter, body) of a markdown text that begins with one between dashes."""
    head = F.regexp_extract(c, r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    return head, F.regexp_replace(c, r"(?s)^---\s*\n.*?\n---\s*\n", "")
