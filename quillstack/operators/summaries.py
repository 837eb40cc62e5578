"""Keywords by TF-IDF in the engine, summaries by sentence ranking in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.graph import top_per

#: Words without weight.
STOP = frozenset("""a about after all also an and any are as at be because been before being both but by can could did do does for from had has have he her his how i if in into is it its just like may me more my no not of on one or other our out she should
so some such than that the their them then there these they this those to up us was we were what when where which while who will with would you your""".split())
_ABBR = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Inc|Ltd|Co|Corp|No|St|vs|v|e\.g|i\.e)\.$")


def keywords(docs: DataFrame, k: int = 10, most_share: float = 0.95) -> DataFrame:
    """(id, place, word, weight): the k words of highest weight per document (id, text), ties by word.

    weight = tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per document; stop words, words of under three letters, and words in more
    than ``most_share`` of the documents are left out. Texts without such words give no rows.
    """
    words = docs.select("id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where((F.length("word") >= 3) & ~F.col("word").isin(sorted(STOP)))
    tf = words.groupBy("id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    idf = df.crossJoin(F.broadcast(n)).where(F.col("df") <= F.col("n") * most_share).select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = tf.join(idf, "word").select("id", "word", (F.col("tf") * F.col("idf")).alias("w"))
    sizes = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    scaled = weights.join(sizes, "id").select("id", "word", F.round(F.col("w") / F.col("size"), 9).alias("weight"))
    return top_per(scaled, "id", [F.desc("weight"), F.col("word")], k).select("id", "place", "word", "weight")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: cut behind . ! ? before a capital or figure, not behind abbreviations, and at line ends."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        parts, at = [], 0
        for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", line):
            if not _ABBR.search(line[at : m.start()]):
                parts.append(line[at : m.start()])
                at = m.end()
        out += [p.strip() for p in [*parts, line[at:]] if p.strip()]
    return out


def ranked_sentences(text: str | None, k: int = 3, least: float = 0.1, same: float = 0.85, longest: int = 1000) -> list[str]:
    """The k best sentences in their order: PageRank over the graph of sentences that share words; near repeats are passed over.

    The whole text is one graph, as a matrix up to ``longest`` sentences and by ``ranked_by_words`` beyond.
    """
    every = sentences(text)
    if len(every) > longest:
        return ranked_by_words(every, k, least, same)
    if len(every) <= k:
        return every
    vocabulary: dict[str, int] = {}
    rows = [[vocabulary.setdefault(w, len(vocabulary)) for w in re.findall("[a-z0-9]{3,}", s.lower()) if w not in STOP] for s in every]
    m = np.zeros((len(every), max(1, len(vocabulary))))
    for i, r in enumerate(rows):
        np.add.at(m[i], r, 1)
    m *= np.log((1 + len(every)) / (1 + (m > 0).sum(0))) + 1
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sims = m @ m.T
    np.fill_diagonal(sims, 0)
    links = np.where(sims >= least, sims, 0)
    out = links.sum(1, keepdims=True)
    step = np.divide(links, out, out=np.full_like(links, 1 / len(every)), where=out > 0)
    rank = np.full(len(every), 1 / len(every))
    for _ in range(30):
        rank = 0.15 / len(every) + 0.85 * (rank @ step)
    chosen: list[int] = []
    for i in np.argsort(-rank, kind="stable"):
        if all(sims[i, j] < same for j in chosen):
            chosen.append(int(i))
        if len(chosen) == k:
            break
    return [every[i] for i in sorted(chosen)]


def ranked_by_words(every: list[str], k: int, least: float, same: float) -> list[str]:
    """``ranked_sentences`` of a long text without a quadratic matrix.

    Sentences with the same words are one node with their number; links are found by the sentences of each word and kept only from
    ``least`` on.
    """
    n = len(every)
    vocabulary: dict[str, int] = {}
    nodes: dict[tuple[int, ...], int] = {}
    node = np.array([nodes.setdefault(tuple(sorted(vocabulary.setdefault(w, len(vocabulary)) for w in re.findall("[a-z0-9]{3,}", s.lower()) if w not in STOP)), len(nodes)) for s in every])
    times = np.bincount(node).astype(float)
    rows = [np.unique(np.array(words, int), return_counts=True) for words in nodes]
    sizes = [len(w) for w, _ in rows]
    word, at = np.concatenate([w for w, _ in rows]), np.repeat(np.arange(len(rows)), sizes)
    df = np.bincount(word, weights=times[at], minlength=len(vocabulary))
    weight = np.concatenate([c for _, c in rows]) * (np.log((1 + n) / (1 + df)) + 1)[word]
    weight /= np.maximum(np.sqrt(np.bincount(at, weights=weight**2, minlength=len(rows))), 1e-12)[at]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(word, kind="stable")
    holders, held = at[order], weight[order]
    first = np.searchsorted(word[order], np.arange(len(vocabulary) + 1))

    def sims(i: int) -> np.ndarray:
        out = np.zeros(len(rows))
        for e in range(begin[i], begin[i + 1]):
            part = slice(first[word[e]], first[word[e] + 1])
            out[holders[part]] += weight[e] * held[part]
        return out

    to, strength = [], []
    for i in range(len(rows)):
        s = sims(i)
        s[i] *= (times[i] - 1) / times[i]  # a sentence has no link to itself, but to its repeats
        to.append(np.flatnonzero((s >= least) | ((s > 0) & (np.arange(len(rows)) == i))).astype(np.int32))
        strength.append(s[to[-1]])
    source = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t in to])
    to, strength = np.concatenate(to), np.concatenate(strength)
    out = np.bincount(source, weights=strength * times[to], minlength=len(rows))
    strength *= times[source] / out[source]
    rank = np.full(len(rows), 1 / n)
    for _ in range(30):
        rank = 0.15 / n + 0.85 * (np.bincount(to, weights=rank[source] * strength, minlength=len(rows)) + (rank * times)[out == 0].sum() / n)
    chosen: list[int] = []
    near = np.zeros(len(rows), bool)
    for i in np.argsort(-np.round(rank * n, 9)[node], kind="stable"):  # ties go to the earlier sentence
        if not near[node[i]]:
            chosen.append(int(i))
            near |= sims(node[i]) >= same
        if len(chosen) == k:
            break
    return [every[i] for i in sorted(chosen)]


def summaries(docs: DataFrame, k: int = 3) -> DataFrame:
    """(id, n_sentences, summary) of documents (id, text); null and empty texts have an empty summary."""

    @F.pandas_udf("n_sentences int, summary array<string>")
    def rank(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n_sentences": [len(sentences(t)) for t in texts], "summary": [ranked_sentences(t, k) for t in texts]})

    return docs.select("id", rank("text").alias("s")).select("id", "s.n_sentences", "s.summary")
