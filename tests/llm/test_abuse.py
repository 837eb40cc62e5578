import random

import numpy as np

from quillstack.llm import abuse as A

DOCS, LABELS = "doc_id long, text string, source string, toxic int, x string", "doc_id long, annotator string, toxic int, text string"
BAD = ["You are a worthless {w} and everybody knows it.", "I hope you rot, {w}.", "Go to hell, you {w}.", "Shut up, you vile {w}, or I will break your jaw."]
GOOD = ["The witness testified that threats were made.", "Counsel will kill the motion and strip the exhibit.", "Could you review the transcript by Friday?", "The naked wire was bare copper.", "Thank you for the keys, I will send the lease."]


def drawn(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        parts = [rng.choice(GOOD) for _ in range(4)] + ([rng.choice(BAD).format(w=rng.choice(["idiot", "1d10t", "m@ggot", "l o s e r", "scumbag", "b****rd"]))] if bad else [])
        rng.shuffle(parts)
        out.append((i, " ".join(parts), bad))
    return out


def test_held_out_accuracy(frame):
    docs = drawn(500, 1)
    rng = random.Random(2)
    labels = [(i, "a", int(b) if rng.random() > 0.05 else int(not b), "t") for i, _, b in docs[:250]] + [(1, None, None, None), (None, "a", 1, None), (99999, "a", 1, None)]
    rows = [(i, t, "s", 0, "x") for i, t, _ in docs]
    got = {r["doc_id"]: r["score"] for r in A.abuse_scores(frame(DOCS, *rows), frame(LABELS, *labels)).collect()}
    right = [(got[i] >= A.THRESHOLD) == b for i, _, b in docs[250:]]
    assert sum(right) / len(right) >= 0.96


def test_without_verdicts_and_edges(frame):
    rows = [(1, "Shut up, you vile scumbag, or I will break your damn jaw.", "s", 1, "x"), (2, None, None, 1, "x"), (3, "", "s", 1, "x"), (3, "", "s", 1, "x"), (4, "fine words " * 100_000, "s", 1, "x")]
    got = [(r["doc_id"], r["source"], r["score"] >= A.THRESHOLD) for r in A.abuse_scores(frame(DOCS, *rows), frame(LABELS)).collect()]
    assert sorted(got, key=str) == [(1, "s", True), (2, None, False), (3, "s", False), (3, "s", False), (4, "s", False)]
    assert A.abuse_scores(frame(DOCS), frame(LABELS)).count() == 0


def test_isotonic():
    tops, values = A.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(values) == [0.0, 0.5, 1.0] and list(tops) == [1.0, 3.0, 4.0]
