"""Repairing text from scanned pages into continuous paragraphs.

A linear-chain conditional model labels the lines of a page by layout as body, heading, furniture (running headers, footers, page and stamp
numbers) or break. Words broken at line ends are joined across furniture; misread words are looked up among the words of all pages after
undoing the usual confusions of characters. The model is trained on a small table of composed pages; words are counted over the whole collection.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.crf import Chain, batches, padded
from quillstack.operators.lineage import scratch

#: Composed pages the line model is trained on; words known without a lookup, at most.
PAGES, CORE = 500, 20_000
LABELS = ["break", "body", "heading", "furniture"]
HYPHENS = "-‐­¬"
_END = re.compile(rf"([^\W\d_]+(?:['’][^\W\d_]+)?|[^\W_]+(?:[-‐][^\W_]+)*)[{HYPHENS}]\s*$")
_EDGE = " \t.,;:!?\"'()[]{}“”‘’«»…|*"
#: What a scanner reads, and what may have stood there.
CONFUSED = {
    "1": "i l", "0": "o", "5": "s", "9": "g", "8": "b", "@": "a", "6": "b g", "3": "e", "|": "l i", "!": "i l", "$": "s", "rn": "m", "m": "rn in", "cl": "d", "d": "cl", "ii": "u", "vv": "w", "w": "vv", "c": "e o", "e": "c", "f": "t", "t": "f",
    "v": "y", "y": "v", "b": "h", "h": "b", "l": "i t", "i": "l", "o": "c a", "u": "ii n", "n": "u ri", "ri": "n", "li": "h", "a": "o", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
}
_DIGITS = str.maketrans("OoQDlI|iSsBZzgb", "000011115582296"[:15])
_NUMBER = re.compile(r"[$€£#]?\d{1,3}(?:,\d{3})+(?:\.\d+)?%?|[$€£#]?\d+(?:\.\d+)?%?|\d{1,4}[/-]\d{1,2}[/-]\d{1,4}|\d{1,2}:\d\d")
_DOCKET = re.compile(r"([\dOolISB]{4})-([A-Z0-9]{2})-([\dOolISB]{4,8})")


_ANY_DIGIT, _SMALL_NUMBER, _OTHER_NUMBER, _ROMAN = re.compile(r"\d"), re.compile(r"\d{1,3}"), re.compile(r"[\d.,$/:-]+"), re.compile("[ivxlIVXL]{1,7}")
_DASHED, _STAMP, _FRACTION = re.compile(r"[-–—~·.\[(]+ ?\w{1,4} ?[-–—~·.\])]+"), re.compile(r"^[A-Z]{1,5}[-_ ]?\d{5,}$"), re.compile(r"\s\d{1,3}\s?/\s?\d{1,3}$")
_PAGE, _OF = re.compile(r"\b(?:p[a@o]ge?|p[a@]9e|pg|p\.|seite|p[aá]gina)\s*\d", re.I), re.compile(r"\b\d+\s+of\s+\d+$")
_DOCKET_NO, _CASE_NO, _VERSUS = re.compile(r"\d{4}-[A-Z0-9]{2}-\d{4,}"), re.compile(r"^c[a@]\w?[e5s9c]\w? n[o0]\b", re.I), re.compile(r"\sv[.s]{0,2}\s")
_IN_RE, _TITLE_DASH = re.compile(r"^[I1l]N R[EF]\b"), re.compile(r"^[A-Z0-9]{4,} - \S")
_GAP, _GAP_NUMBER = re.compile(r"\S {3,}\S"), re.compile(r" {3,}\d{1,4}$")
#: Words of the longest line that furniture repeats.
AGAIN = 8


# --- Labelling of lines ---
def line_features(line: str, seen: int) -> list[str]:
    """Layout of one line. ``seen`` is how often its shape occurs on the page."""
    s = line.strip()
    if not s:
        return ["blank"]
    letters = [c for c in s if c.isalpha()]
    words = s.split()
    n, digit = len(words), _ANY_DIGIT.search(s) is not None
    out = ["bias", f"words{min(n, 6)}", f"len{min(len(s) // 12, 6)}"]
    caps = bool(letters) and sum(c.isupper() for c in letters) > 0.9 * len(letters)
    if caps:
        out.append("caps" if len(letters) > 3 else "caps_short")
    if n == 1:
        if _SMALL_NUMBER.fullmatch(s):
            out.append("small_number")
        elif _OTHER_NUMBER.fullmatch(s):
            out.append("other_number")
        if _ROMAN.fullmatch(s):
            out.append("roman")
    if n <= 3 and digit and _DASHED.fullmatch(s):
        out.append("dashed_number")
    if digit and (_PAGE.search(s) or _OF.search(s)):
        out.append("page_word")
    if n <= 2 and digit and _STAMP.match(s):
        out.append("stamp")
    if "___" in s:
        out.append("ruled")
    if "/" in s and digit and _FRACTION.search(s):
        out.append("fraction")
    if digit and "-" in s and _DOCKET_NO.search(s):
        out.append("docket" if n <= 6 else "docket_in_text")
    if n <= 6 and s[0] in "cC" and _CASE_NO.match(s):
        out.append("case_no")
    if "caps" in out and _VERSUS.search(s):
        out.append("versus")
    if s[0] in "I1l" and _IN_RE.match(s):
        out.append("in_re")
    if n <= 6 and " - " in s and _TITLE_DASH.match(s):
        out.append("title_dash")
    if "   " in s:
        if _GAP.search(s):
            out.append("gap")
        if digit and _GAP_NUMBER.search(s):
            out.append("gap_number")
    if line[:2] == "  ":
        out.append("indented")
    out.append("stop" if s[-1] in ".!?:;" else "comma" if s[-1] in "," else "hyphen" if s[-1] in HYPHENS else "open")
    out.append("lower" if s[0].islower() else "upper" if s[0].isupper() else "digit" if s[0].isdigit() else "other")
    if seen > 1 and n <= AGAIN:
        out.append("again")
    if "docket" in out and "lower" not in out and n <= 3 and out[-1] != "lower":
        out.append("docket_alone")
    return out


#: Layouts that furniture shows; a line with none of them is text.
FURNITURE = {"small_number", "roman", "dashed_number", "page_word", "stamp", "ruled", "fraction", "docket", "case_no", "versus", "in_re", "title_dash", "gap", "gap_number", "caps", "again"}


def shape(line: str) -> str:
    return re.sub(r"\d+", "9", re.sub(r"\s+", " ", line.strip().lower()))


def units_of(pages: list[list[str]], memo: dict[tuple, int], units: list[list[str]]) -> list[list[int]]:
    """Pages as lists of unit numbers; distinct feature lists are added to ``units``."""
    out = []
    for lines in pages:
        shapes = [shape(x) if len(x.split(None, AGAIN)) <= AGAIN else "" for x in lines]
        counts = Counter(shapes)
        row = []
        for x, y in zip(lines, shapes):
            feats = line_features(x, counts[y] if y else 1)
            key = tuple(feats)
            if key not in memo:
                memo[key] = len(units)
                units.append(feats)
            row.append(memo[key])
        out.append(row)
    return out


def composed_pages(n: int = PAGES, seed: int = 5) -> tuple[list[list[str]], list[list[int]]]:
    """A small labelled table: pages composed of sentences, headings, stray figures and furniture of many kinds."""
    rng = random.Random(seed)
    stem = "the of and court report tenant a shall pay under notice roof was found signed before hearing with terms payment repair in order to letter agreed by party unit door water lease at file".split()
    name = lambda: rng.choice(["Anna", "Paul", "Rita", "Otto", "Vera", "Hugh"]) + " " + rng.choice(["Marlen", "Tobrick", "Sorvane", "Keldworth", "Ostrand", "Belavich"])
    firm = lambda: rng.choice(["NORTHGATE", "SILVERHILL", "OAKMERE"]) + " " + rng.choice(["ROOFING SERVICES LLC", "LAW OFFICES", "REALTY GROUP INC.", "HOLDINGS CORP."])
    docket = lambda: f"{rng.randint(2015, 2026)}-{rng.choice(['CA', 'CC', 'DR', 'SC', 'CV'])}-{rng.randint(0, 999999):06d}"

    def sentence() -> list[str]:
        w = [rng.choice(stem) for _ in range(rng.randint(5, 24))]
        if rng.random() < 0.25:
            w.insert(rng.randint(0, len(w)), rng.choice([docket(), f"${rng.randint(1, 40)},{rng.randint(100, 999)}", str(rng.randint(2015, 2026)), name(), firm().title(), f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/2021"]))
        if rng.random() < 0.25:
            w += rng.choice([["on", "April", f"{rng.randint(1, 30)},", str(rng.randint(2015, 2026))], ["in", "Port", "Keldworth"], ["by", *firm().title().split()], ["of", f"${rng.randint(1, 40)},{rng.randint(100, 999)}.50"], ["exhibit", str(rng.randint(1, 99))], ["case", docket(), "is", "stricken"]])
        w[0] = w[0].capitalize()
        return [*w[:-1], w[-1] + "."]

    def furniture(no: int, total: int) -> str:
        kind = rng.randint(0, 13)
        pad = "   " if rng.random() < 0.3 else ""
        return pad + [
            str(no), f"- {no} -", f"Page {no} of {total}", f"Page {no}   {docket()}", ["i", "ii", "iii", "iv", "v", "vi", "vii"][no % 7], f"{rng.choice(['BRX', 'DEF', 'ABC', 'TR'])}{rng.randint(10000, 9999999):07d}",
            f"Seen by ____   {no}/{total}", f"{rng.choice(['MOTION', 'ORDER', 'LETTER', 'LEASE', 'REPORT', 'COMPLAINT'])} - {name()}", f"IN RE {name().split()[1].upper()}", f"{name().split()[1].upper()} v. {firm()}",
            f"{firm()}     {rng.randint(2015, 2026)}", f"Case No. {docket()}", f"Case No. {docket()}   Page {no}", f"{rng.choice(['Ca5e', 'Casc', 'C@se'])} No. {docket()}" + rng.choice(["", f"   Page {no}"]),
        ][kind]

    pages, gold = [], []
    for _ in range(n):
        lines, marks = [], []
        no, total, width = rng.randint(1, 9), rng.randint(9, 30), rng.randint(48, 100)
        fixed = [furniture(no, total) for _ in range(2)]
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.35:
                made = " ".join(rng.choice(stem + ["facts", "statement", "notes", "room", "terms", "schedule", "exhibit"]) for _ in range(rng.randint(1, 3))).upper()
                lines += [rng.choice(["SUMMARY", "ANNEX B", "OVERVIEW", "Remarks", "Dear Mr. Keldworth:", made, made, made]), ""]
                marks += [2, 0]
            if rng.random() < 0.3:
                no += 1
                block = [rng.choice([furniture(no, total), rng.choice(fixed)]) for _ in range(rng.choice([1, 1, 2]))]
                after = rng.random() < 0.7
                lines += block + [""] * after
                marks += [3] * len(block) + [0] * after
            if rng.random() < 0.2:
                lines += [rng.choice([str(rng.randint(2005, 2026)), f"{rng.randint(1, 99)},{rng.randint(100, 999)}", f"${rng.randint(1, 9)},{rng.randint(100, 999)}.00"]), ""]
                marks += [1, 0]
            words = [w for _ in range(rng.randint(1, 7)) for w in sentence()]
            row = ""
            for w in words:
                if len(row) + len(w) > width:
                    if rng.random() < 0.2 and len(w) > 5:
                        row, w = f"{row} {w[:3]}-", w[3:]
                    lines.append(row)
                    marks.append(1)
                    row = w
                    if rng.random() < 0.06:
                        no += 1
                        block = [rng.choice([furniture(no, total), rng.choice(fixed)]) for _ in range(rng.choice([1, 1, 1, 2]))]
                        before, after = rng.random() < 0.4, rng.random() < 0.5
                        lines += [""] * before + block + [""] * after
                        marks += [0] * before + [3] * len(block) + [0] * after
                else:
                    row = f"{row} {w}".strip()
            lines += [row, ""]
            marks += [1, 0]
        if rng.random() < 0.4:
            lines, marks = [furniture(no, total), *lines], [3, *marks]
        if rng.random() < 0.4:
            lines, marks = [*lines, furniture(no + 1, total)], [*marks, 3]
        pages.append(lines)
        gold.append(marks)
    return pages, gold


@lru_cache(maxsize=1)
def line_model() -> Chain:
    """The model trained on the composed pages, once per driver."""
    pages, gold = composed_pages()
    memo, units = {(): 0}, [[]]
    rows = units_of(pages, memo, units)
    return Chain(LABELS, (-2, -1, 0, 1, 2)).fit(units, padded(rows), padded(gold), rounds=50)


def label_lines(pages: list[list[str]], model: Chain) -> list[np.ndarray]:
    """Label numbers of the lines of many pages."""
    memo, units = {(): 0}, [[]]
    rows = units_of(pages, memo, units)
    table = model.tables(*model.flat(units), len(units))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
    for some in batches(rows):
        got = model.decode(table, padded([rows[k] for k in some]))
        for k, g in zip(some, got):
            g = g[: len(rows[k])]
            blank = np.array([not x.strip() for x in pages[k]], bool)
            out[k] = np.where(blank, 0, np.where(g == 0, 1, g))
            for i in np.flatnonzero(~blank):  # layouts that admit one reading only
                feats = units[rows[k][i]]
                if out[k][i] == 3 and not FURNITURE & set(feats):
                    out[k][i] = 1
                elif out[k][i] == 3 and "stop" in feats and not {"page_word", "case_no", "versus", "in_re", "title_dash", "gap_number", "dashed_number"} & set(feats):
                    out[k][i] = 1
                elif out[k][i] == 3 and "caps" in feats and not {"versus", "in_re", "title_dash", "gap_number", "stamp", "docket", "page_word", "case_no", "ruled"} & set(feats):
                    out[k][i] = 2
                elif out[k][i] != 3 and {"dashed_number", "roman", "stamp", "small_number"} & set(feats):
                    out[k][i] = 3
                elif out[k][i] != 3 and {"page_word", "ruled", "case_no"} & set(feats) and "lower" not in feats and not {"stop", "comma"} & set(feats) and "words6" not in feats:
                    out[k][i] = 3
    return out


# --- Words ---
class Tokens(dict):
    """What a token as it stands in a line is: (bare, word or '', small letters, begins with a capital, ends a sentence), remembered."""

    def __missing__(self, raw: str) -> tuple[str, str, str, bool, bool]:
        if len(self) > 200_000:
            self.clear()
        w = raw.strip(_EDGE)
        word = w.rstrip(HYPHENS) if w.strip(HYPHENS) else ""
        got = self[raw] = (w, word, word.lower(), w[:1].isupper() and len(w) > 1, raw.rstrip("\"')”’").endswith((".", "!", "?", ":")))
        return got


_TOKENS = Tokens()


def page_items(lines: list[str], labels: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """(broken words, words) of the body of a page.

    Broken: (line_no, left, right, mark). Words: (line_no, word, in small letters, starts a sentence, between capitalised words).
    """
    body = [i for i, k in enumerate(labels) if k in (1, 2)]
    broken, words = [], []
    skip_first: set[int] = set()
    skip_last: set[int] = set()
    for a, i in enumerate(body):
        m = lines[i].rstrip()[-1:] in HYPHENS and _END.search(lines[i])
        if m and labels[i] == 1 and a + 1 < len(body):
            j = body[a + 1]
            right = lines[j].split()[0] if lines[j].split() else ""
            bare = right.strip(_EDGE)
            if bare and bare[0].isalpha() and labels[j] == 1:
                broken.append((i + 1, m[1], bare, m[0][len(m[1])]))
                skip_last.add(i)
                skip_first.add(j)
    before, stop, look = False, True, _TOKENS
    for i in body:
        parts = [look[raw] for raw in lines[i].split()]
        last = len(parts) - 1
        for k, (w, word, low, titled, ends) in enumerate(parts):
            if w:
                if word and not (k == 0 and i in skip_first) and not (k == last and i in skip_last):
                    words.append((i + 1, word, low, stop, k < last and parts[k + 1][3] or before and not stop))
                before = titled
                stop = ends
            else:
                stop = ends or stop
        if i + 1 < len(labels) and labels[i + 1] == 0 and raw_end(lines[i]):
            stop = True
    return broken, words


def raw_end(line: str) -> bool:
    return line.rstrip().endswith((".", "!", "?", ":"))


def restored(word: str) -> list[str]:
    """Lower-case readings of a word with one confusion undone, or all of the digits and signs in it."""
    low = word.lower()
    out: list[str] = []
    for k in range(len(low)):
        for size in (1, 2):
            part = low[k : k + size]
            if len(part) == size and part in CONFUSED:
                out += [low[:k] + x + low[k + size :] for x in CONFUSED[part].split()]
    signs = [k for k, c in enumerate(low) if not c.isalpha() and c in CONFUSED]
    if len(signs) > 1:
        every = [""]
        for c in low:
            options = CONFUSED[c].split() if not c.isalpha() and c in CONFUSED else [c]
            every = [e + o for e in every for o in options][:64]
        out += every
    return list(dict.fromkeys(x for x in out if x != low))


def number_of(word: str) -> str | None:
    """The number a token with letters in it must have been, or None."""
    m = _DOCKET.fullmatch(word)
    if m:
        middle = m[2].translate(str.maketrans("5081", "SOBI"))
        fixed = f"{m[1].translate(_DIGITS)}-{middle}-{m[3].translate(_DIGITS)}"
        return fixed if fixed != word and middle.isalpha() else None
    if not any(c.isalpha() for c in word) or sum(c.isdigit() for c in word) * 2 < sum(c.isalnum() for c in word) or not any(c.isdigit() for c in word):
        return None
    fixed = word.translate(_DIGITS)
    return fixed if _NUMBER.fullmatch(fixed) else None


def with_case(read: str, fixed: str, starts: bool, among: bool) -> str:
    """``fixed`` (lower case) in the case of the word as read; a first letter that was misread takes the case of its place."""
    letters = [c for c in read if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and (len(letters) > 1 or len(read) > 2 and among):
        return fixed.upper()
    if "-" in fixed and "-" in read and fixed.count("-") == read.count("-"):
        return "-".join(with_case(a, b, starts and k == 0, among) for k, (a, b) in enumerate(zip(read.split("-"), fixed.split("-"))))
    if read[:1].isalpha():
        return fixed[:1].upper() + fixed[1:] if read[0].isupper() else fixed
    return fixed[:1].upper() + fixed[1:] if starts or among else fixed


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, clean, scanned, titled): occurrences of lower-case words in born digital and in scanned chunks, broken words left out.

    ``titled`` counts those written with a capital within a sentence.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            clean, scanned, titled = Counter(), Counter(), Counter()
            for text, ocr in zip(part["text_content"], part["ocr"]):
                if not text:
                    continue
                lines = text.split("\n")
                _, words = page_items(lines, np.array([1 if x.strip() else 0 for x in lines]))
                (scanned if ocr else clean).update([w[2] for w in words])
                titled.update([w[2] for w in words if not w[3] and w[1][0].isupper()])
            for c in (clean, scanned):  # the parts of compounds are words as well
                c.update({p: n for w, n in list(c.items()) if "-" in w for p in w.split("-") if p.isalpha()})
            every = list(clean.keys() | scanned.keys())
            yield pd.DataFrame({"word": every, "clean": [clean[w] for w in every], "scanned": [scanned[w] for w in every], "titled": [titled[w] for w in every]})

    rows = chunks.select("text_content", (F.col("extraction_method") == "ocr").alias("ocr")).where("text_content != ''").withColumn("ocr", F.coalesce("ocr", F.lit(False)))
    return rows.mapInPandas(count, "word string, clean long, scanned long, titled long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"), F.sum("titled").alias("titled"))


def repairs(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no, kind, word, read) of scanned chunks (extraction_method 'ocr'): furniture, hyphen and misread.

    Null and empty texts have no lines; null ids are kept as they are. Identical rows give identical results, made distinct. Without
    born digital pages words are judged by the scanned ones alone. Texts are worked through whole.
    """
    spark = chunks.sparkSession
    keep = scratch(spark, "scans")
    counts = keep.keep(word_counts(chunks))
    core = frozenset(r["word"] for r in counts.where("clean >= 3").orderBy(F.desc("clean"), "word").limit(CORE).select("word").toLocalIterator())
    known, shipped = spark.sparkContext.broadcast(core), spark.sparkContext.broadcast(line_model())

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        for part in parts:
            pages = [t.split("\n") for t in part["text_content"]]
            rows = []
            for chunk, lines, labels in zip(part["chunk_id"], pages, label_lines(pages, model)):
                rows += [(chunk, int(i) + 1, "furniture", "", "", False, False) for i in np.flatnonzero(labels == 3)]
                broken, words = page_items(lines, labels)
                rows += [(chunk, n, "hyphen", a, b, h == "-", False) for n, a, b, h in broken]
                for n, w, low, starts, among in words:
                    if low in known.value:
                        continue
                    fixed = number_of(w)
                    if fixed:
                        rows.append((chunk, n, "number", w, fixed, False, False))
                    elif any(c.isalpha() for c in w) and len(w) > 1:
                        rows.append((chunk, n, "word", w, "", starts, among))
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "what", "a", "b", "x", "y"])

    pages = chunks.where((F.col("extraction_method") == "ocr") & (F.col("text_content") != "")).select("chunk_id", "text_content").distinct()
    items = keep.keep(pages.mapInPandas(read, "chunk_id string, line_no int, what string, a string, b string, x boolean, y boolean"))

    @F.pandas_udf("array<string>")
    def readings(words: pd.Series) -> pd.Series:
        return words.map(restored)

    @F.pandas_udf("array<string>")
    def bases(words: pd.Series) -> pd.Series:
        """A word, without a genitive s, or the parts of a compound that need a look."""
        return words.map(lambda w: [x for x in dict.fromkeys([re.sub(r"['’]s$", "", p) for p in [w, *(w.split("-") if "-" in w else [])]]) if x])

    # Distinct unusual words, and the parts of compounds, are looked up once each.
    words = items.where("what = 'word'").select(F.lower("a").alias("word")).distinct()
    parts = words.select("word", F.explode(bases("word")).alias("part"))
    single = keep.keep(parts.select("part").distinct().join(counts.withColumnRenamed("word", "part"), "part", "left").select("part", F.coalesce("clean", F.lit(0)).alias("clean"), F.coalesce("scanned", F.lit(0)).alias("scanned")))
    doubtful = single.where("clean = 0").select("part", "scanned", F.explode(readings("part")).alias("reading"))
    better = doubtful.join(counts.select(F.col("word").alias("reading"), F.col("clean").alias("rc"), F.col("scanned").alias("rs")), "reading")
    odd = F.col("part").rlike("[0-9@|!$ﬀ-ﬄ]")
    weight = F.col("rc") * 10 + F.col("rs")
    better = better.where(odd & (weight >= 1) | (F.col("rc") >= 1) | (F.col("rs") >= 3 * F.col("scanned")) & (F.col("rs") >= 3))
    better = better.where(~F.col("reading").rlike("[0-9@|!$ﬀ-ﬄ]"))
    best = keep.keep(better.groupBy("part").agg(F.max_by("reading", F.struct(weight.alias("w"), F.col("reading"))).alias("fixed")))
    good = single.where("clean > 0").select("part").withColumn("good", F.lit(True))
    judged = parts.join(best, "part", "left").join(good, "part", "left").groupBy("word").agg(F.collect_list(F.struct("part", "fixed", "good")).alias("parts"))

    @F.pandas_udf("string")
    def whole(words: pd.Series, parts: pd.Series) -> pd.Series:
        """The repaired word, or null: a known whole stands; else it is replaced, or its doubtful parts are."""

        def one(w: str, ps) -> str | None:
            fix, ok = {p["part"]: p["fixed"] for p in ps}, {p["part"] for p in ps if p["good"]}
            tail = "" if not (m := re.search(r"['’]s$", w)) else m[0]
            base = w[: len(w) - len(tail)]
            if base in ok:
                return None
            if fix.get(base):
                return fix[base] + tail
            pieces = base.split("-")
            if len(pieces) > 1:
                new = [p if p in ok else fix.get(p) or plainly(p) or p for p in pieces]
                return "-".join(new) + tail if new != pieces else None
            return plainly(base) + tail if plainly(base) else None

        return pd.Series([one(w, p) for w, p in zip(words, parts)])

    fixes = keep.keep(judged.select("word", whole("word", "parts").alias("fixed")).where("fixed is not null"))

    @F.pandas_udf("string")
    def cased(read_: pd.Series, fixed: pd.Series, starts: pd.Series, among: pd.Series) -> pd.Series:
        return pd.Series([with_case(r, x, a, b) if x is not None else None for r, x, a, b in zip(read_, fixed, starts, among)])

    capital = counts.where("titled * 10 > clean + scanned").select(F.col("word").alias("fixed"), F.lit(True).alias("capital"))
    fixes = fixes.join(capital, "fixed", "left").select("word", "fixed", F.coalesce("capital", F.col("fixed").contains("-"), F.lit(False)).alias("capital"))
    misread = items.where("what = 'word'").withColumn("word", F.lower("a")).join(fixes, "word").withColumn("y", F.col("y") & F.col("capital")).select("chunk_id", "line_no", F.lit("misread").alias("kind"), cased("a", "fixed", "x", "y").alias("word"), F.col("a").alias("read"))
    numbers = items.where("what = 'number'").select("chunk_id", "line_no", F.lit("misread").alias("kind"), F.col("b").alias("word"), F.col("a").alias("read"))

    # Broken words: the joined and the hyphenated form compete by their counts.
    broken = items.where("what = 'hyphen'").select("chunk_id", "line_no", F.col("a").alias("left"), F.col("b").alias("right"), F.col("x").alias("hard"))
    pairs = broken.select("left", "right").distinct()
    forms = pairs.select("left", "right", F.explode(F.array(F.concat("left", "right"), F.concat("left", F.lit("-"), "right"))).alias("form"))
    ranked = forms.withColumn("word", F.lower("form")).withColumn("word", F.regexp_replace("word", "['’]s$", ""))
    ranked = ranked.join(counts, "word", "left").withColumn("kept", F.col("form").contains("-") & ~F.col("left").contains("-") | (F.col("form") == F.concat("left", F.lit("-"), "right")))
    ranked = ranked.groupBy("left", "right").agg(
        F.max(F.when(~F.col("kept"), F.coalesce("clean", F.lit(0)) * 10 + F.coalesce("scanned", F.lit(0))).otherwise(0)).alias("one"),
        F.max(F.when(F.col("kept"), F.coalesce("clean", F.lit(0)) * 10 + F.coalesce("scanned", F.lit(0))).otherwise(0)).alias("two"))
    known_parts = counts.where("clean >= 3")
    ranked = ranked.withColumn("l", F.lower("left")).join(known_parts.select(F.col("word").alias("l"), F.lit(1).alias("lk")), "l", "left").withColumn("r", F.lower(F.regexp_replace("right", "['’]s$", ""))).join(known_parts.select(F.col("word").alias("r"), F.lit(1).alias("rk")), "r", "left")
    joined = F.concat("left", "right")
    apart = F.concat("left", F.lit("-"), "right")
    choice = F.when(F.col("two") > F.col("one"), apart).when(F.col("one") > 0, joined).when(F.col("lk").isNotNull() & F.col("rk").isNotNull() & (F.length("left") > 2) & (F.length("right") > 3), apart).otherwise(joined)
    hyphens = broken.join(ranked.select("left", "right", choice.alias("word"), (F.greatest("one", "two") > 0).alias("sure")), ["left", "right"])
    # A broken word nobody knows may be misread as well.
    unsure = hyphens.where(~F.col("sure")).select(F.lower("word").alias("low")).distinct().select("low", F.explode(readings("low")).alias("reading"))
    mended = unsure.join(counts.where("clean > 0").select(F.col("word").alias("reading"), "clean"), "reading").groupBy("low").agg(F.max_by("reading", F.struct("clean", "reading")).alias("mended"))
    hyphens = hyphens.withColumn("low", F.lower("word")).join(mended, "low", "left").select("chunk_id", "line_no", F.lit("hyphen").alias("kind"), F.when(F.col("mended").isNotNull(), cased("word", "mended", F.lit(False), F.lit(False))).otherwise(F.col("word")).alias("word"), F.concat("left", F.lit("\n"), "right").alias("read"))
    furniture = items.where("what = 'furniture'").select("chunk_id", "line_no", F.lit("furniture").alias("kind"), F.lit("").alias("word"), F.lit("").alias("read"))
    return furniture.unionByName(hyphens).unionByName(misread).unionByName(numbers).distinct()


def plainly(word: str) -> str | None:
    """A word with figures or signs among letters, put right without lookup; None if there is nothing to do."""
    plain = unicodedata.normalize("NFKC", word)
    if plain != word and plain.isalpha():
        return plain
    if len(word) < 3 or sum(c.isalpha() for c in word) < 2 or not any(c in "01589@" for c in word) or word[:1].isdigit() and sum(c.isdigit() for c in word) > 1:
        return None
    if re.search(r"\d{2,}", word) or not re.fullmatch(r"[a-z01589@'’]+", word):
        return None
    out = ""
    for k, c in enumerate(word):
        near = (out[-1:] or "") + word[k + 1 : k + 2]
        out += {"0": "o", "5": "s", "9": "g", "8": "b", "@": "a"}.get(c) or (("i" if not all(x in "aeiou" for x in near) else "l") if c == "1" else c)
    return out


def repaired_texts(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk_id, text): scanned chunks as paragraphs, without furniture, with broken words joined and misread words replaced."""
    fixes = found.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "kind", "word", "read"))).alias("fixes"))
    pages = chunks.where(F.col("extraction_method") == "ocr").select("chunk_id", "text_content").distinct().join(fixes, "chunk_id", "left")

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"chunk_id": part["chunk_id"], "text": [paragraphs(t, f) for t, f in zip(part["text_content"], part["fixes"])]})

    return pages.mapInPandas(build, "chunk_id string, text string")


def paragraphs(text: str | None, fixes) -> str:
    """One page put together: blank lines end a paragraph only where a sentence ends."""
    if not text:
        return ""
    lines: list[str | None] = list(text.split("\n"))
    join: dict[int, tuple[str, str]] = {}
    for f in fixes if fixes is not None else ():
        i = f["line_no"] - 1
        if f["kind"] == "furniture":
            lines[i] = None
        elif f["kind"] == "hyphen":
            join[i] = (f["word"], f["read"].split("\n")[1])
        elif lines[i] is not None:
            lines[i] = re.sub(rf"(?<!\w){re.escape(f['read'])}(?!\w)", lambda m, w=f["word"]: w, lines[i])
    out, row, pending = [], "", None
    for i, line in enumerate(lines):
        if line is None:
            continue
        if not line.strip():
            if row and pending is None and row.endswith((".", "!", "?", ":", '"', "”")):
                out.append(row)
                row = ""
            continue
        line = " ".join(line.split())
        if pending is not None:
            line = line[line.find(pending) + len(pending) :] if pending in line else line
            pending = None
            row += line
        else:
            row = f"{row} {line}".strip()
        if i in join:
            row, pending = row[: row.rfind(" ") + 1] + join[i][0], join[i][1]
    return "\n\n".join([*out, row] if row else out)
