from datetime import datetime

import numpy as np

from quillstack.llm import neighbours as N

SCHEMA = "id long, content_id long, vector array<float>, dim int, model string, created_at timestamp_ntz, cell int, part string"


def row(i, c, v, model="legal-bert", at=datetime(2024, 1, 1)):
    return (i, c, v if v is None else [float(x) for x in v], 64, model, at, 1, "x")


def test_recall_and_pairs(frame, monkeypatch):
    """Clustered vectors over several cells, shards and slices: recall of at least 0.95 against brute force."""
    monkeypatch.setattr(N, "CELL", 200)
    monkeypatch.setattr(N, "SHARD", 150)
    monkeypatch.setattr(N, "SLICE", 300)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([c + 0.25 * rng.normal(size=(15, 64)) for c in centres]).astype(np.float32)
    rows = [row(i, i, v) for i, v in enumerate(x)] + [row(9000, 5, x[800], at=None), row(9001, 6, x[6], at=datetime(2023, 1, 1)), row(9002, 7000, None), row(9003, 7001, np.zeros(64)), row(9004, 7002, x[0][:32]), row(9005, 7003, x[0], "old")]
    got = N.nearest_items(N.usable(frame(SCHEMA, *rows))).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    truth = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-sims[i])[:5]}
    found = {(r["content_id"], r["neighbour"]) for r in got}
    assert len(found) == 5 * len(x) and len(truth & found) / len(truth) >= 0.95


def test_small_tables(frame):
    assert N.nearest_items(N.usable(frame(SCHEMA))).count() == 0
    assert N.nearest_items(N.usable(frame(SCHEMA, row(1, 1, np.ones(64))))).count() == 0
    same = frame(SCHEMA, *[row(i, i, np.ones(64)) for i in range(4)])
    pairs = N.neighbour_pairs(N.nearest_items(N.usable(same)))
    assert pairs.count() == 6


def test_graph_is_bounded():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, starts = N.build(x)
    assert graph.shape == (300, N.DEGREE) and graph.max() < 300 and len(starts) and (graph[:, 0] >= 0).all()


def test_copies_are_one_node(frame):
    """A third of the rows are one vector: each copy has the smallest other copies, and no copy enters a graph twice."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 64)).astype(np.float32)
    rows = [row(i, i, v) for i, v in enumerate(x)] + [row(100 + i, 100 + i, x[7]) for i in range(30)] + [row(200, 200, x[9])]
    got = {}
    for r in N.nearest_items(N.usable(frame(SCHEMA, *rows))).collect():
        got.setdefault(r["content_id"], []).append(r["neighbour"])
    assert set(got) == {r[1] for r in rows} and all(len(v) == 5 == len(set(v)) for v in got.values())
    class_ = [7, *range(100, 130)]
    assert all(set(got[c]) == set([m for m in class_ if m != c][:5]) for c in class_)
    assert 200 in got[9] and 9 in got[200]
