import os
import random

import pytest

from quillstack.llm import packing as P

SCHEMA = "doc_id long, n_tokens long, container string, part string"


def packed(frame, sizes, capacity=100):
    df = frame(SCHEMA, *[(i, n, "x", "y") for i, n in sizes])
    return [tuple(r) for r in P.pack(df, capacity).collect()]


def test_nothing_overflows_or_is_lost(frame):
    rng = random.Random(1)
    sizes = [(i, rng.randint(1, 60)) for i in range(3000)] + [(9001, 350), (9002, 100), (9003, 0), (9004, None), (9005, 101)]
    got = packed(frame, sizes)
    used: dict = {}
    docs: dict = {}
    for c, d, p, n in got:
        used[c] = used.get(c, 0) + n
        docs.setdefault(d, []).append((p, n))
    assert max(used.values()) <= 100 and set(docs) == {i for i, _ in sizes}
    assert all(sum(n for _, n in docs[i]) == (s or 0) for i, s in sizes)
    assert all(len(docs[i]) == 1 for i, s in sizes if (s or 0) <= 100) and len(docs[9001]) == 4 and len(docs[9005]) == 2
    assert sum(used.values()) / (100 * len(used)) > 0.97


def test_edges(frame):
    assert packed(frame, []) == []
    assert [r[1:] for r in packed(frame, [(1, 5)])] == [(1, 0, 5)]
    with pytest.raises(ValueError):
        packed(frame, [(1, 5)], 0)
    assert len(packed(frame, [(1, 5), (1, 5)])) == 2


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer file")
def test_tokens(frame):
    long = "the roof leaks and the tenant complains " * 10_000
    assert abs(P.count_tokens(long) - len(P.encoding(P.TOKENIZER).encode_ordinary(long))) <= 8
    got = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(frame("doc_id long, text string, n_tokens int", (1, "hello world", 1), (2, None, 1), (3, "", 1))).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0
