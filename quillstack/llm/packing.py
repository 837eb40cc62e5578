"""Filling containers of fixed capacity with texts, sized in tokens of a public tokenizer.

Each partition packs its texts as they come, with a fixed number of open containers: a text goes where the least room remains after
it, and when none has room the fullest container is sent out. Containers left over at the ends of the partitions, at most OPEN each,
are merged in further rounds over ever fewer tasks. A text that alone exceeds the capacity is split into full containers and a rest,
which is packed like a text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.lineage import scratch

#: Tokens of a container, open containers of a task, and the places of tokenizer files. The path is a parameter of ``token_counts``.
CAPACITY, OPEN, TOKENIZER = 2048, 64, "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters given to the tokenizer at once.
STRETCH = 100_000
#: A container at least so full is not merged any more; leftover containers merged per task.
FULL, MERGE = 0.98, 4096


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a text. Very long texts are counted in stretches that end before white space, where the tokenizer cuts anyway; one without any stays whole."""
    enc = encoding(path)
    if len(text) <= STRETCH:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        if end < len(text):
            space = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = space if space > at else min((k for k in (text.find(" ", end), text.find("\n", end)) if k >= 0), default=len(text))
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of documents (doc_id, text); null and empty texts have 0 tokens."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [count_tokens(t, path) if t else 0 for t in part["text"]]})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long")


class Windows:
    """Open containers of one task: least room first."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, list]] = []  # (room, items), sorted by room

    def place(self, size: int, item) -> list | None:
        """Put an item away; a container that had to leave for it is returned."""
        import bisect

        at = bisect.bisect_left(self.open, size, key=lambda w: w[0])
        gone = None
        if at < len(self.open):
            room, items = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                gone = self.open.pop(0)[1]
            room, items = self.capacity, []
        items.append(item)
        bisect.insort(self.open, (room - size, items), key=lambda w: w[0])
        return gone


def pack(sizes: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN) -> DataFrame:
    """(container, doc_id, part, n_tokens): every document once, or in parts 0, 1, ... if it exceeds ``capacity``.

    Takes (doc_id, n_tokens); null or negative sizes count as 0 and repeated rows are packed once each. Documents of no tokens go
    into containers like others. An empty table gives no rows. Container names depend on the contents only, so that a task that
    runs again gives the same result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    keep = scratch(spark, "packing")
    pieces = sizes.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n"))
    parts = pieces.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity).cast("long") - 1, F.lit(0).cast("long")))).alias("part"))
    parts = parts.select("doc_id", "part", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part") * capacity).alias("n_tokens"))
    # Texts travel once, as ids and sizes; the order within a task follows the hash, so that large and small ones mix.
    parts = keep.keep(parts)
    tasks = max(1, min(spark.sparkContext.defaultParallelism * 2, parts.count() // 2000))
    dealt = parts.repartition(tasks, F.xxhash64("doc_id", "part")).sortWithinPartitions(F.xxhash64("part", "doc_id"), "doc_id", "part")
    shape = "container string, docs array<long>, parts array<long>, sizes array<long>, used long"

    def frame(bins: list[list]) -> pd.DataFrame:
        rows = []
        for items in bins:
            items = sorted(items)
            first = items[0]
            rows.append((f"{first[0]}-{first[1]}", [i[0] for i in items], [i[1] for i in items], [i[2] for i in items], sum(i[2] for i in items)))
        return pd.DataFrame(rows, columns=["container", "docs", "parts", "sizes", "used"])

    def first_round(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Windows(capacity, open_windows)
        for part in frames:
            gone = [g for d, p, n in zip(part["doc_id"], part["part"], part["n_tokens"]) if (g := w.place(n, (d, p, n)))]
            if gone:
                yield frame(gone)
        if w.open:
            yield frame([items for _, items in w.open])

    bins = keep.keep(dealt.mapInPandas(first_round, shape))
    done: list[DataFrame] = []

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Leftover containers are packed like items, the fullest first."""
        w = Windows(capacity, MERGE)
        for part in frames:
            gone = []
            for docs, ps, ns, used in zip(part["docs"], part["parts"], part["sizes"], part["used"]):
                items = list(zip(docs, ps, ns))
                if g := w.place(int(used), items):
                    gone.append([i for group in g for i in group])
            if gone:
                yield frame(gone)
        if w.open:
            yield frame([[i for group in items for i in group] for _, items in w.open])

    while True:
        loose = bins.where(F.col("used") < FULL * capacity)
        n = loose.count()
        done.append(bins.where(F.col("used") >= FULL * capacity))
        if n <= 1:
            done.append(loose)
            break
        merged = keep.keep(loose.repartition(-(-n // MERGE), F.xxhash64("container")).sortWithinPartitions(F.desc("used"), "container").mapInPandas(merge, shape))
        if merged.count() > 0.98 * n:
            done.append(merged)
            break
        bins = merged
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    item = F.explode(F.arrays_zip("docs", "parts", "sizes")).alias("i")
    return every.select("container", item).select("container", F.col("i.docs").alias("doc_id"), F.col("i.parts").alias("part"), F.col("i.sizes").alias("n_tokens"))
