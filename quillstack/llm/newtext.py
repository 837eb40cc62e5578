"""Reducing each email to the text its sender newly wrote.

Threads are rebuilt from the reference headers that stand in the bodies: the line that introduces a quotation names the minute of
the quoted mail, which is looked up within the thread. The words of a mail are then held against those of its ancestors: shared
shingles, found by a rolling hash, are extended to aligned runs, and lines made of inherited words are removed together with the lines
that introduce them. Closing formulas, signatures, disclaimers and device footers are removed from what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, share of a line's words that must be inherited.
SHINGLE, INHERITED = 4, 0.6
#: Factor of the rolling hash, words of texts that a task remembers.
BASE, REMEMBERED = np.uint64(1_000_003), 2_000_000

_MONTHS = {m: i % 12 + 1 for i, m in enumerate("january february march april may june july august september october november december jan feb mar apr may jun jul aug sep oct nov dec".split())}
_PREFIX = re.compile(r"^\s{0,3}[>|:](?:\s|[>|:]|$|(?=\S))")
_MARKS = re.compile(r"^(?:\s*[>|:](?=[\s>|:]|$|\S))+\s?")
_WROTE = re.compile(
    r"(?:wrote|writes|schrieb|escribi[óo]|a écrit|ha scritto)\s*:?\s*$|\bwrote on \d{1,2}[./]\d{1,2}[./]\d{4} \d{1,2}:\d\d\s*:\s*$|^Am .{0,40}\d\d:\d\d schrieb .{1,120}:\s*$", re.I)
_OPENS = re.compile(r"^(?:On|Am|El|Le|Il) .{0,30}\d{4}.{0,200}$|^.{1,120}<[^<>]+@[^<>]+>\s*$", re.I)
_RULED = re.compile(r"^\s*-{2,}\s*(?:original message|forwarded message|mensaje original|mensaje reenviado|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|message original)\s*-{2,}\s*$|^\s*begin forwarded message:\s*$", re.I)
_HEADER = re.compile(r"^\s*\*?(?:from|sent|date|to|cc|bcc|subject|reply-to|de|enviado(?: el)?|fecha|para|asunto|von|gesendet|datum|an|betreff|envoyé|à|objet)\s?:\*?\s*\S", re.I)
_FROM = re.compile(r"^\s*\*?(?:from|de|von)\s?:\*?\s*\S", re.I)
_SENT = re.compile(r"^\s*\*?(?:sent|date|to|subject|enviado(?: el)?|fecha|para|asunto|gesendet|datum|an|betreff|envoyé|à|objet)\s?:\*?\s*\S", re.I)
_RULE = re.compile(r"^\s*[_*=]{8,}\s*$")
_CLOSING = re.compile(
    r"^\s*(?:(?:with |many )?(?:kind(?:est)?|best|warm(?:est)?|kindest) (?:regards|wishes)|regards|best|all the best|cheers|sincerely(?: yours)?|yours (?:truly|sincerely|faithfully)|respectfully(?: yours)?|cordially|"
    r"thanks(?: again| so much| very much| in advance)?|many thanks|thank you(?: very much| again| in advance)?|thx|talk soon|speak soon|take care|warmly|"
    r"(?:un |muchos )?(?:cordial(?:es)? )?saludos?(?: cordial(?:es)?)?|atentamente|gracias|un abrazo|cordialement|bien (?:à vous|cordialement)|salutations|merci|"
    r"(?:mit )?(?:freundlichen?|besten?|herzlichen?|viele) gr(?:ü|ue)(?:ß|ss)en?|mfg|danke)\s*[,.!;–-]?\s*$", re.I)
_DASHES = re.compile(r"^\s*(?:--|—|__)\s*$")
_FOOTER = re.compile(
    r"^\s*(?:sent from (?:my|a|an)\b(?!.*:.*\bphotos?\b)|sent (?:via|using) |get .{3,30} for (?:ios|android|mobile)|enviado desde (?:mi|el)\b|envoyé de(?:puis)? mon|von meinem .{2,30} gesendet|gesendet von|"
    r"this is an automat|please do not reply|este (?:es un )?mensaje (?:automático|es confidencial)|ce (?:message|courriel) est confidentiel|diese (?:e-?mail|nachricht) ist vertraulich|"
    r"please consider the environment|(?:confidentiality|legal|privacy|important)? ?(?:notice|disclaimer)\s*:|"
    r"this (?:e-?mail|message|communication)(?: message)?(?:,? (?:and|including) any (?:files|attachments?)\b.*| (?:is|are|may|contains?|was|and its)\b.*\b(?:confidential|privileged|intended|addressee).*| may contain (?:privileged|confidential).*)|"
    r"privileged (?:and|&) confidential\b|confidential (?:and|&) privileged\b|attorney[- ]client privileged|if you are not the (?:intended|named)|if you (?:have )?received this|the views (?:expressed )?in this (?:mail|e-?mail|message)|"
    r"nothing (?:contained )?in this (?:message|e-?mail|communication)\b|(?:any )?(?:tax|legal|investment) (?:advice|comments?|remarks?|statements?)\b.*\bnot\b)", re.I)
_WORD = re.compile(r"\w+")


def stamps(line: str) -> list[str]:
    """Minutes named in a line that introduces a quotation, as yyyy-mm-dd hh:mm."""
    out = []
    for m in re.finditer(r"(\d{1,2})[./](\d{1,2})[./](\d{4}),? +(?:um |a las |à )?(\d{1,2}):(\d\d)", line):
        out.append((int(m[3]), int(m[2]), int(m[1]), int(m[4]), int(m[5])))
    for m in re.finditer(r"([A-Za-z]{3,9})\.? (\d{1,2}), (\d{4}),?(?: at)? (\d{1,2}):(\d\d)(?:\s*([AaPp])\.?[Mm])?", line):
        if m[1].lower() in _MONTHS:
            hour = int(m[4]) % 12 + (12 if m[6] in "Pp" else 0) if m[6] else int(m[4])
            out.append((int(m[3]), _MONTHS[m[1].lower()], int(m[2]), hour, int(m[5])))
    good = []
    for parts in out:
        try:
            good.append(datetime(*parts).strftime("%Y-%m-%d %H:%M"))
        except ValueError:
            pass
    return good


def lines_of(content: str) -> list[str]:
    return [x.rstrip("\r").replace("\xa0", " ") for x in content.split("\n")]


def says(line: str) -> bool:
    """Whether a line ends in a word of saying; most lines lack them all, and need no pattern."""
    low = line.lower()
    return ("wrote" in low or "writes" in low or "schrieb" in low or "escribi" in low or "crit" in low) and _WROTE.search(line) is not None


def intro_ends(lines: list[str]) -> list[int]:
    """For every line the line after an introduction of a quotation that begins there, or its own number if none does."""
    said = [says(x) for x in lines]
    said.append(False)
    n, out = len(lines), []
    for i, line in enumerate(lines):
        first, end = line.lstrip()[:1], i
        if not first:
            pass
        elif first in "-bB" and _RULED.match(line):
            j = i + 1
            while j < n and not lines[j].strip():
                j += 1
            end = headers_end(lines, j) if j < n and _FROM.match(lines[j]) else i + 1
        elif first == "_" and i + 1 < n and _RULE.match(line) and _FROM.match(lines[i + 1]):
            end = headers_end(lines, i + 1)
        elif first in "*fFdDvV" and i + 1 < n and _FROM.match(line) and _SENT.match(lines[i + 1]):
            end = headers_end(lines, i)
        elif said[i] and len(line) < 250 and stamps(line):
            end = i + 1
        elif said[i + 1] and len(lines[i + 1]) < 120 and _OPENS.match(line) and stamps(line + " " + lines[i + 1]):
            end = i + 2
        out.append(end)
    return out


def headers_end(lines: list[str], i: int) -> int:
    while i < len(lines) and _HEADER.match(lines[i]):
        i += 1
    return i


def references(content: str | None) -> list[str]:
    """Minutes of the mails that a body says it quotes, each once."""
    if not content:
        return []
    lines, out, i = lines_of(content), [], 0
    ends = intro_ends(lines)
    while i < len(lines):
        end = ends[i]
        if end > i:
            out += stamps(" ".join(lines[i:end]))
        i = max(end, i + 1)
    return list(dict.fromkeys(out))


def words_of_line(line: str) -> list[str]:
    """Words in small letters, without the marks of quotation."""
    return _WORD.findall((_MARKS.sub("", line) if line.lstrip()[:1] in (">", "|", ":") else line).lower())


def rolled(words: list[str]) -> np.ndarray:
    """Rolling hash of every SHINGLE words, modulo 2**64."""
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = out * BASE + codes[k : k + len(out)]
    return out


class Words(dict):
    """Words of texts, line by line one behind the other, remembered while they are small: a mail has many descendants."""

    size = 0

    def __missing__(self, text: str) -> list[str]:
        got = [w for line in lines_of(text) for w in words_of_line(line)]
        self.size += len(got)
        if self.size > REMEMBERED:
            self.clear()
            self.size = len(got)
        self[text] = got
        return got


_SEEN = Words()


class Ancestors:
    """Words of the ancestors of a mail, indexed by the rolling hash of their shingles."""

    def __init__(self, texts: list[str]):
        self.words: list[str] = []
        for t in texts:
            self.words += _SEEN[t]
            self.words.append("")
        self.hashes = rolled(self.words)

    def inherited(self, words: list[str]) -> list[bool]:
        """Which words lie in runs aligned with an ancestor; runs that go on where the last one ended are preferred."""
        marked, a = [False] * len(words), self.words
        mine = rolled(words)
        where: dict[int, list[int]] = {}
        shared = np.flatnonzero(np.isin(self.hashes, mine))
        for p, h in zip(shared.tolist(), self.hashes[shared].tolist()):
            where.setdefault(h, []).append(p)
        hashes, i, last = mine.tolist(), 0, 0
        while i < len(hashes):
            at = [p for p in where.get(hashes[i], ()) if a[p : p + SHINGLE] == words[i : i + SHINGLE]]
            if not at:
                i += 1
                continue
            p = min((p for p in at if p >= last), default=at[0])
            lo, q = i, p
            while lo > 0 and q > 0 and not marked[lo - 1] and a[q - 1] == words[lo - 1]:
                lo, q = lo - 1, q - 1
            hi, q = i + SHINGLE, p + SHINGLE
            while hi < len(words) and q < len(a) and a[q] == words[hi]:
                hi, q = hi + 1, q + 1
            marked[lo:hi] = [True] * (hi - lo)
            last, i = q, hi
        return marked


def quoted_lines(lines: list[str], ancestors: list[str]) -> list[bool]:
    """Lines that are quoted or introduce a quotation."""
    n = len(lines)
    gone = [False] * n
    ends = intro_ends(lines)
    if not ancestors and all(end == i for i, end in enumerate(ends)):
        return gone
    share = [0.0] * n
    counts = [0] * n
    if ancestors:
        flat, owner = [], []
        for i, line in enumerate(lines):
            ws = words_of_line(line)
            counts[i] = len(ws)
            flat += ws
            owner += [i] * len(ws)
        for o, m in zip(owner, Ancestors(ancestors).inherited(flat)):
            share[o] += m
        share = [s / c if c else 0.0 for s, c in zip(share, counts)]
    i = 0
    while i < n:
        end = ends[i]
        if end == i:
            i += 1
            continue
        gone[i:end] = [True] * (end - i)
        j = end
        while j < n and not lines[j].strip():
            j += 1
        if j == n:
            break
        mark = lines[j].lstrip()[:1] if _PREFIX.match(lines[j]) else ""
        if mark:  # marked quotation: new lines may stand between its lines
            known = bool(ancestors) and any(share[k] >= INHERITED for k in range(j, n) if lines[k].lstrip()[:1] == mark)
            k = j
            while k < n and (k == j or ends[k] == k):
                bare = lines[k].strip(" >|:")
                if lines[k].lstrip()[:1] == mark and _PREFIX.match(lines[k]):
                    lone = known and counts[k] >= SHINGLE and share[k] == 0 and k > j and not (lines[k - 1].lstrip()[:1] == mark or k + 1 < n and lines[k + 1].lstrip()[:1] == mark)
                    gone[k] = not lone or not bare
                k += 1
            i = k
        elif lines[j].startswith("    ") or lines[j].startswith("\t"):
            k = j
            while k < n and (lines[k].startswith(("    ", "\t")) or not lines[k].strip()):
                gone[k] = True
                k += 1
            i = k
        elif ancestors and any(share[k] >= INHERITED for k in range(j, min(n, j + 12))):
            k = j  # plain quotation: as far as the ancestors' words go
            while k < n:
                if counts[k] and share[k] < INHERITED and not _PREFIX.match(lines[k]) and ends[k] == k:
                    ahead = list(islice((share[x] for x in range(k + 1, n) if counts[x]), 3))
                    if not any(s >= INHERITED for s in ahead):
                        break
                gone[k] = True
                k += 1
            i = k
        else:
            gone[j:] = [True] * (n - j)
            i = n
    return gone


def ends_segment(lines: list[str], some: list[int], names: set[str]) -> int:
    """Index into ``some`` where the closing, signature or footer of a stretch of new lines begins."""
    cut = len(some)
    for k, i in enumerate(some):
        line = lines[i]
        if _DASHES.match(line) or _FOOTER.match(line):
            cut = k
            break
        if _CLOSING.match(line) or _RULE.match(line):
            rest = list(islice((x for x in some[k + 1 :] if lines[x].strip()), 15))
            closes = len(rest) <= 14 and (not rest or len(lines[rest[0]].strip()) <= 60)
            if closes if _CLOSING.match(line) else rest and _FOOTER.match(lines[rest[0]]):
                cut = k
                break
    # A lone name of the sender before that is a sign-off.
    k = cut - 1
    while k >= 0 and not lines[some[k]].strip():
        k -= 1
    if k > 0 and lines[some[k]].strip() and not lines[some[k - 1]].strip():
        words = [w.lower() for w in _WORD.findall(lines[some[k]])]
        if 0 < len(words) <= 3 and all(w in names for w in words) and not lines[some[k]].rstrip().endswith((",", ":", "?")):
            cut = k
    return cut


def new_lines(content: str | None, sender: str | None, ancestors: list[str] | None) -> list[int]:
    """Numbers, from 1, of the non-blank lines that the sender newly wrote. Null or empty content has none."""
    if not content:
        return []
    lines = lines_of(content)
    gone = quoted_lines(lines, [a for a in ancestors or [] if a])
    names = {w.lower() for w in _WORD.findall((sender or "").split("@")[0] + " " + (sender or "").partition("<")[0].partition("(")[2])} | {w.lower() for w in _WORD.findall((sender or "").partition("<")[0])}
    out: list[int] = []
    stretch: list[int] = []
    for i in range(len(lines) + 1):
        if i < len(lines) and not gone[i]:
            stretch.append(i)
            continue
        if stretch:
            keep = stretch[: ends_segment(lines, stretch, names)]
            out += [k + 1 for k in keep if lines[k].strip()]
            stretch = []
    return out


def subject_key(subject: F.Column | str) -> F.Column:
    return F.concat(F.lit("s:"), F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(subject), F.lit("")), r"(?i)^(\s*(re|fwd?|aw|wg|rv|tr)\s*:\s*)+", ""))))


def new_text(emails: DataFrame) -> DataFrame:
    """(id, new_lines, new_text) of emails (id, content, sender, subject, thread_id, datetime_utc).

    Null or empty content gives no lines and an empty text. Mails without thread are placed by their subject, mails without date are
    nobody's ancestor, nor are those without id. The same mail stored again is one ancestor. Extra columns are ignored, an empty table gives no rows.
    """

    @F.pandas_udf("array<string>")
    def refer(content: pd.Series) -> pd.Series:
        return content.map(references)

    thread = F.when(F.col("thread_id").isNotNull(), F.concat(F.lit("t:"), "thread_id"))
    mails = emails.select("id", "content", "sender", "datetime_utc", thread.alias("thread"), subject_key("subject").alias("subject"))
    asked = mails.where("content != ''").select("id", F.coalesce("thread", "subject").alias("place"), refer("content").alias("refs")).where("size(refs) > 0")
    asked = asked.select("id", "place", F.explode("refs").alias("minute")).select("id", F.concat_ws(" ", "minute", "place").alias("key"))
    # Mails meet by short keys and hashes; whole texts travel only where one is another's ancestor, equal texts once.
    offered = mails.where("content != '' and datetime_utc is not null").select(
        F.explode(F.array_distinct(F.array(F.coalesce("thread", "subject"), "subject"))).alias("place"), F.date_format("datetime_utc", "yyyy-MM-dd HH:mm").alias("minute"), F.col("id").alias("ancestor"), F.xxhash64("content", F.length("content")).alias("print")
    ).select(F.concat_ws(" ", "minute", "place").alias("key"), "ancestor", "print").groupBy("key", "print").agg(F.min("ancestor").alias("ancestor"))
    pairs = asked.join(offered, "key").groupBy("id", "print").agg(F.min("ancestor").alias("ancestor"))
    texts = mails.where("content != ''").select(F.col("id").alias("ancestor"), F.xxhash64("content", F.length("content")).alias("print"), "content")
    found = pairs.join(texts, ["ancestor", "print"]).groupBy("id").agg(F.sort_array(F.collect_set("content")).alias("ancestors"))
    both = mails.select("id", "content", "sender").join(found, "id", "left")

    def reduce(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            numbers = [new_lines(c, s, list(a) if a is not None else None) for c, s, a in zip(part["content"], part["sender"], part["ancestors"])]
            texts = ["\n".join(lines_of(c)[k - 1] for k in ks) if c else "" for c, ks in zip(part["content"], numbers)]
            yield pd.DataFrame({"id": part["id"], "new_lines": numbers, "new_text": texts})

    return both.mapInPandas(reduce, "id long, new_lines array<int>, new_text string")
