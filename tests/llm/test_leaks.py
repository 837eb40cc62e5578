import random

import numpy as np

from quillstack.llm import leaks as L

DOCS, ITEMS = "doc_id long, text string, item_id string, held int", "item_id long, suite string, text string, doc_id int"


def brute(doc, item):
    """Share of the item's words in common runs of six words or more."""
    d, i = L.words(doc), L.words(item)
    grams = {tuple(d[k : k + 6]) for k in range(len(d) - 5)}
    held = {k + j for k in range(len(i) - 5) if tuple(i[k : k + 6]) in grams for j in range(6)}
    return len(held) / len(i) if i else 0


def test_against_brute_force(frame):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 60))) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(20))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(texts).split()
            a = rng.randrange(len(w))
            parts.append(" ".join(w[a : a + rng.randint(4, 40)]))
        rng.shuffle(parts)
        docs.append((d, " zz ".join(parts)))
    items = frame(ITEMS, *[(k, "s", t, 1) for k, t in enumerate(texts)])
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked(frame(DOCS, *[(d, t, "x", 1) for d, t in docs]), items).where("held >= 0.4").collect()}
    assert got == {(d, k) for d, t in docs for k, i in enumerate(texts) if brute(t, i) >= 0.4} and got


def test_disguise_and_edges(frame, monkeypatch):
    item = "The crooked fisher guarded a cabin inside the rapid creek, yet the mason partitioned its walnut."
    leaked = "<p>THE CROOKED <b>fisher</b> guarded&nbsp;a cab-\nin inside; the rapid\n\n  creek yet THE mason</p>"
    items = frame(ITEMS, (1, "s", item, 1), (2, "s", item, 1), (3, "s", "too short", 1), (4, "s", None, 1), (None, "s", item, 1))
    docs = frame(DOCS, (1, leaked, "", 1), (2, None, "", 1), (3, "", "", 1), (4, "the crooked fisher guarded a", "", 1), (5, "noise " * 200_000 + item, "", 1))
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (5, 1), (5, 2)}
    monkeypatch.setattr(L, "ITEMS", 1)
    assert {(r["doc_id"], r["item_id"]) for r in L.leaked(docs, items).collect()} == got
    assert L.leaked(docs, items.where("false")).count() == 0 and L.leaked(docs.where("false"), items).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    others = np.array([prints[k % 200] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k % 12 + 1).astype(np.uint64)) for k in range(600)], np.uint64)
    for radius in (0, 3, 7):
        left, right = L.Blocks(prints, radius).near(others)
        apart = np.bitwise_count(others[:, None] ^ prints[None])
        assert set(zip(left.tolist(), right.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(apart <= radius)]))


def altered(rng, ws, n):
    ws = list(ws)
    for k in rng.sample(range(len(ws)), n):
        ws[k] = f"z{rng.randrange(10**6)}"
    return ws


def test_near_copies_against_brute_force(monkeypatch):
    """Items with some words changed: nearly all windows similar enough are found, and fewer by a smaller radius."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(20, 120))] for _ in range(80)]
    docs = [["a"] * rng.randint(0, 30) + altered(rng, items[d % 80], rng.randint(0, 2)) + ["b"] * rng.randint(0, 30) for d in range(240)]
    texts = [" ".join(w) for w in items]

    def found(radius):
        index = L.ItemIndex(list(range(80)), texts, radius)
        ids = np.array([index.vocabulary.get(w, -1) for w in sum(docs, [])], np.int32)
        return index, {(d, i) for d, i, _, similar in index.leaks(np.repeat(np.arange(240), [len(w) for w in docs]), ids) if similar >= L.NEAR}

    index, got = found(L.RADIUS)
    want = set()
    for d, w in enumerate(docs):
        ids = np.array([index.vocabulary.get(x, -1) for x in w], np.int32)
        n, i = len(items[d % 80]), d % 80
        if max(index.similarity(i, ids[k : k + n]) for k in range(len(ids) - n + 1)) >= L.NEAR:
            want.add((d, i))
    assert got <= want and len(got) >= 0.9 * len(want) > 100
    assert len(found(0)[1]) < len(got)


def test_report(frame):
    item = "The crooked fisher guarded a cabin inside the rapid creek, yet the mason partitioned its walnut under every lavish oven and left the grainy harbor whistle beside it."
    docs = frame(DOCS, (1, item, "", 1), (2, item.replace("lavish", "narrow"), "", 1), (3, "The crooked fisher guarded a cabin inside the rapid creek, yet the mason slept.", "", 1), (4, "The crooked fisher guarded a boat.", "", 1))
    report = L.leak_report(L.leaked(docs, frame(ITEMS, (1, "s", item, 1)))).collect()
    assert [(r["item_id"], r["n_docs"], r["n_near"], r["most_held"], r["most_similar"]) for r in report] == [(1, 3, 1, 1.0, 1.0)]
