"""Passages of evaluation items inside corpus documents.

SimHash fingerprints choose candidates, in windows of two sizes. Item-sized windows, one fingerprint an item, find copies of an item with a
few words changed. A document that holds only part of an item has no such window, so items and documents are also cut into windows of
PASSAGE words, the shortest passage that counts. Fingerprints are looked up by a multi-index: four blocks of 16 bits, of which one at least
is within a fourth of the radius, so every fingerprint within the radius is found. A candidate (document, item) is then verified as a whole:
the share of the item's words in shared passages, counted exactly, and the similarity of five-word shingles weighted by their rarity among
the items, over the best item-sized window.

The items are the stated query set. Their indexes travel to the tasks in blocks of at most ITEMS items, whose size is checked; each worker
builds an index once. The corpus is read once, whatever the number of blocks up to BLOCKS, and never shuffled.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest passage, share of an item's words that must be held, words of a shingle, similarity of a near copy.
PASSAGE, SHARE, SHINGLE, NEAR = 6, 0.4, 5, 0.8
#: Bits that fingerprints of passages and of item-sized windows may differ in.
PASSAGE_RADIUS, RADIUS = 3, 7
#: Items and characters of a block, at most (one longer item travels alone), and blocks looked up in one reading of the corpus.
ITEMS, CHARS, BLOCKS = 20_000, 20_000_000, 8
#: Characters of text worked on at once in a task.
PIECE = 4_000_000
#: Item-sized windows are exact up to 1 / STEP words and from there within this share.
STEP = 0.05

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_BROKEN = re.compile(r"(?<=[^\W\d_])(?:-|‐|­)[ \t]*\r?\n[>|\s]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words(text: str) -> list[str]:
    """Words in lower case, without markup, punctuation, spacing and breaks within a word at a line end."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text or "­" in text:
        text = _BROKEN.sub("", text).replace("­", "")
    return _WORD.findall(text.lower())


def word_bits(vocabulary: list[str]) -> np.ndarray:
    """A row of 64 signs (+1, -1) per word, from its hash."""
    import xxhash

    raw = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
    bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def packed(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs > 0, axis=1).view(np.uint64).ravel()


def passage_prints(ids: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """SimHash of the PASSAGE words from each start. Position counts: each place turns the word's bits by its own step."""
    total = np.zeros((len(starts), 64), np.int8)
    for k in range(PASSAGE):
        total += np.roll(bits, 11 * k, axis=1)[ids[starts + k]]
    return packed(total)


def passage_keys(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit keys of the PASSAGE words from each start."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(PASSAGE):
        out = (out ^ ids[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingles(ids: np.ndarray) -> set[bytes]:
    return {ids[k : k + SHINGLE].tobytes() for k in range(len(ids) - SHINGLE + 1)}


def window_size(n: int) -> int:
    """Words of the window for an item of ``n`` words: the largest of a fixed row of sizes that fits."""
    size = PASSAGE
    while (following := max(size + 1, int(size * (1 + STEP)))) <= n:
        size = following
    return size


class Blocks:
    """Finds all fingerprints within ``radius`` bits: in one of four blocks two such fingerprints differ by radius // 4 bits at most."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        flips = np.zeros(1, np.uint64)
        for _ in range(radius // 4):
            flips = np.unique(np.concatenate([flips, *(flips ^ np.uint64(1 << b) for b in range(16))]))
        every = np.repeat(np.arange(len(prints)), len(flips))
        self.blocks = []
        for k in range(4):
            keys = (((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF))[:, None] ^ flips).ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << 16))]), every[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, place in the indexed fingerprints) of all pairs within the radius, each once."""
        if not len(prints) or not len(self.prints):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for k, (starts, every) in enumerate(self.blocks):
            own = ((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            lo, n = starts[own], starts[own + 1] - starts[own]
            left = np.repeat(np.arange(len(prints)), n)
            right = every[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(left[close] * len(self.prints) + right[close])
        return np.divmod(np.unique(np.concatenate(found)), len(self.prints))


class ItemIndex:
    """Fingerprints of all items and what is needed to verify a candidate."""

    def __init__(self, names: list[int], texts: list[str], radius: int = RADIUS, passage_radius: int = PASSAGE_RADIUS):
        every = [words(t) for t in texts]
        kept = [k for k, ws in enumerate(every) if len(ws) >= PASSAGE]
        every = [every[k] for k in kept]
        self.names = np.array([names[k] for k in kept], np.int64)
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in every for w in ws))}
        self.bits = word_bits(list(self.vocabulary)) if self.vocabulary else np.zeros((0, 64), np.int8)
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in every]
        self.lengths = np.array([len(i) for i in self.ids], np.int64)
        # Rarity of words and of shingles among the items, in sixteenths.
        held = np.bincount(np.concatenate([np.unique(i) for i in self.ids]), minlength=len(self.vocabulary)) if self.ids else np.zeros(0)
        self.weights = np.round(16 * (np.log((1 + len(self.ids)) / (1 + held)) + 1)).astype(np.int32)
        self.unknown = int(np.round(16 * (np.log(1 + len(self.ids)) + 1)))
        self.signs = self.bits * self.weights[:, None]
        self.shingles = [shingles(i) for i in self.ids]
        seen: dict[bytes, int] = {}
        for some in self.shingles:
            for s in some:
                seen[s] = seen.get(s, 0) + 1
        self.rare = float(np.log(1 + len(self.ids)) + 1)
        self.rarity = {s: float(np.log((1 + len(self.ids)) / (1 + n)) + 1) for s, n in seen.items()}
        self.sums = [sum(self.rarity[s] for s in some) for some in self.shingles]
        # Passages; equal ones have one number.
        starts = [np.arange(len(i) - PASSAGE + 1) for i in self.ids]
        self.item = np.repeat(np.arange(len(self.ids)), [len(s) for s in starts])
        self.place = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        every = np.concatenate([np.lib.stride_tricks.sliding_window_view(i, PASSAGE) for i in self.ids]) if self.ids else np.zeros((0, PASSAGE), np.int32)
        self.passages, number = np.unique(every, axis=0, return_inverse=True)
        self.order = np.argsort(number.ravel(), kind="stable")
        keys = passage_keys(self.passages.ravel(), np.arange(len(self.passages)) * PASSAGE)
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(number.ravel(), minlength=len(self.passages)))])
        prints = [passage_prints(i, s, self.bits) for i, s in zip(self.ids, starts)]
        self.parts = Blocks(np.concatenate(prints) if prints else np.zeros(0, np.uint64), passage_radius)
        # Item-sized windows.
        sizes = np.array([window_size(n) for n in self.lengths], np.int64)
        whole = np.stack([self.signs[i[:n]].sum(0) for i, n in zip(self.ids, sizes)]) if self.ids else np.zeros((0, 64))
        self.whole = {int(n): (np.flatnonzero(sizes == n), Blocks(packed(whole[sizes == n]), radius)) for n in np.unique(sizes)}

    @staticmethod
    def known(docs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Starts of windows of PASSAGE words of one document; a window with a word that no item has is no passage of an item."""
        n = len(ids) - PASSAGE + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        return np.flatnonzero((bad[PASSAGE:] == bad[:-PASSAGE]) & (docs[PASSAGE - 1 :] == docs[:n]))

    def by_passages(self, docs: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Candidates document * items + item, by windows of PASSAGE words from the starts ``at``."""
        left, right = self.parts.near(passage_prints(ids, at, self.bits))
        return np.unique(docs[at[left]] * len(self.names) + self.item[right])

    def by_windows(self, docs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Rows (document * items + item, start) of item-sized windows whose fingerprints are near an item's.

        A window can only be a near copy if words the items know make up NEAR of its weight; the others get no fingerprint.
        """
        weight = np.where(ids < 0, -NEAR * self.unknown, (1 - NEAR) * self.weights[ids])
        spare = np.concatenate([[0], np.cumsum(weight)])  # what known words weigh more than they must
        open_at = {}
        wanted = np.zeros(len(ids) + 1, np.int32)
        for size in self.whole:
            if size <= len(ids):
                at = np.flatnonzero(spare[size:] - spare[:-size] >= -1e-6)
                at = at[docs[at] == docs[at + size - 1]]
                if len(at):
                    open_at[size] = at
                    np.add.at(wanted, at, 1)
                    np.add.at(wanted, at + size, -1)
        if not open_at:
            return np.zeros((0, 2), np.int64)
        # Sums of signs over the words of those windows only.
        inside = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
        index = np.zeros(len(ids) + 1, np.int64)
        index[inside + 1] = 1
        index = np.cumsum(index)
        own = ids[inside]
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(np.where(own[:, None] < 0, 0, self.signs[own]), axis=0, dtype=np.int32)])
        found = []
        for size, at in open_at.items():
            items, blocks = self.whole[size]
            for some in np.array_split(at, -(-len(at) // 100_000)):
                left, right = blocks.near(packed(sums[index[some + size]] - sums[index[some]]))
                found.append(np.stack([docs[some[left]] * len(self.names) + items[right], some[left]], 1))
        return np.concatenate(found)

    def held(self, docs: np.ndarray, ids: np.ndarray, at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Share of the item's words in passages that the document holds too, of every candidate document * items + item (sorted)."""
        keys = passage_keys(ids, at)
        lo = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[lo] == keys
        at, lo = at[same], self.by_key[lo[same]]
        same = (ids[at[:, None] + np.arange(PASSAGE)] == self.passages[lo]).all(1)
        at, lo = at[same], lo[same]
        n = self.starts[lo + 1] - self.starts[lo]
        spot = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[lo], n)]
        pair = np.repeat(docs[at], n) * len(self.names) + self.item[spot]
        mine = np.searchsorted(pairs, pair)
        good = pairs[np.minimum(mine, len(pairs) - 1)] == pair
        longest = int(self.lengths.max()) + 1
        cover = np.unique((np.unique(mine[good] * longest + self.place[spot[good]])[:, None] + np.arange(PASSAGE)).ravel())
        return np.bincount(cover // longest, minlength=len(pairs)) / self.lengths[pairs % len(self.names)]

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted share of five-word shingles that the item and a window have in common."""
        mine, other = self.shingles[item], shingles(window)
        common = sum(self.rarity[s] for s in mine & other)
        return common / (self.sums[item] + sum(self.rarity.get(s, self.rare) for s in other - mine))

    def leaks(self, docs: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(document, item, share of the item's words held, similarity of the best item-sized window) of every candidate.

        ``ids`` are the words (-1 for words no item has) of documents ``docs``, one behind the other.
        """
        if not len(self.names) or not len(ids):
            return []
        at = self.known(docs, ids)
        parts, windows = self.by_passages(docs, ids, at), self.by_windows(docs, ids)
        best: dict[int, float] = {int(p): 0.0 for p in parts}
        edges = {int(d): (int(lo), int(hi)) for d, lo, hi in zip(*self._stretches(docs))}
        for pair, start in windows.tolist():
            d, item = divmod(pair, len(self.names))
            window = ids[start : min(start + int(self.lengths[item]), edges[d][1])]
            best[pair] = max(best.get(pair, 0.0), self.similarity(item, window))
        pairs = np.array(sorted(best), np.int64)
        if not len(pairs):
            return []
        d, item = np.divmod(pairs, len(self.names))
        return list(zip(d.tolist(), item.tolist(), self.held(docs, ids, at, pairs).tolist(), (best[p] for p in pairs.tolist())))

    @staticmethod
    def _stretches(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        return docs[lo], lo, np.append(lo[1:], len(docs))


_INDEXES: dict[str, list[ItemIndex]] = {}


def indexes(key: str, blocks: list[tuple[list[int], list[str]]]) -> list[ItemIndex]:
    """The indexes of the current query, built once a worker and kept while tasks of that query follow."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = [ItemIndex(*b) for b in blocks]
    return _INDEXES[key]


def item_blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of at most ITEMS items and CHARS characters, in order of their id."""
    names: list[int] = []
    texts: list[str] = []
    size = 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if names and (len(names) >= ITEMS or size + len(row["text"]) > CHARS):
            yield names, texts
            names, texts, size = [], [], 0
        names.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    if names:
        yield names, texts


def leaked(documents: DataFrame, items: DataFrame, share: float = SHARE, near: float = NEAR) -> DataFrame:
    """(doc_id, item_id, held, similar) of documents (doc_id, text) that hold at least ``share`` of an item's words in passages of PASSAGE
    words or more, or a window at least ``near`` similar to the whole item.

    Null and empty texts hold nothing and leak nothing; items shorter than a passage can't leak. Equal items all count. Repeated
    rows give repeated results. No items or documents give no rows. Texts are worked through whole, whatever their length.
    """
    out: DataFrame | None = None
    blocks: list[tuple[list[int], list[str]]] = []
    for block in item_blocks(items):
        blocks.append(block)
        if len(blocks) == BLOCKS:
            out = _scanned(documents, blocks, share, near, out)
            blocks = []
    if blocks:
        out = _scanned(documents, blocks, share, near, out)
    if out is None:
        return documents.where(F.lit(False)).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("held"), F.lit(0.0).alias("similar"))
    return out


def _scanned(documents: DataFrame, blocks: list[tuple[list[int], list[str]]], share: float, near: float, before: DataFrame | None) -> DataFrame:
    shipped, key = documents.sparkSession.sparkContext.broadcast(blocks), uuid.uuid4().hex

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = indexes(key, shipped.value)
        for part in parts:
            names = part["doc_id"].to_numpy()
            some: list[tuple[int, list[str]]] = []
            size = 0
            for k, text in enumerate(part["text"]):
                some.append((k, words(text)))
                size += len(text)
                if size > PIECE:
                    yield rows(known, names, some)
                    some, size = [], 0
            if some:
                yield rows(known, names, some)

    def rows(known: list[ItemIndex], names: np.ndarray, some: list[tuple[int, list[str]]]) -> pd.DataFrame:
        docs, found = np.repeat([k for k, _ in some], [len(ws) for _, ws in some]).astype(np.int64), []
        for index in known:
            get = index.vocabulary.get
            ids = np.array([get(w, -1) for _, ws in some for w in ws], np.int32)
            found += [(names[d], index.names[i], held, similar) for d, i, held, similar in index.leaks(docs, ids) if held >= share or similar >= near]
        return pd.DataFrame(found, columns=["doc_id", "item_id", "held", "similar"])

    out = documents.where(F.length("text") > 0).select("doc_id", "text").mapInPandas(scan, "doc_id long, item_id long, held double, similar double")
    return out if before is None else before.unionByName(out)


def leak_report(found: DataFrame, share: float = SHARE, near: float = NEAR) -> DataFrame:
    """Per item: documents that hold it, documents with a near copy of the whole item, the largest share held and the largest similarity."""
    return found.groupBy("item_id").agg(
        F.countDistinct(F.when(F.col("held") >= share, F.col("doc_id"))).alias("n_docs"), F.countDistinct(F.when(F.col("similar") >= near, F.col("doc_id"))).alias("n_near"),
        F.max("held").alias("most_held"), F.max("similar").alias("most_similar"))
