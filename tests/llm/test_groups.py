import random

from quillstack.llm.groups import connected_groups, match_edges

SCHEMA = "content_id_1 string, content_id_2 string, similarity_score double, a string, x int, label int"


def brute(pairs):
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in parent}


def test_shapes(frame):
    """Leaves, chains, cycles of even and odd length, stars, cliques and random graphs at once."""
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(1000, 1040)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(2100 + i, 2100 + (i + 1) % 8) for i in range(8)]
    pairs += [(3000, 3001 + i) for i in range(60)] + [(4000 + i, 4000 + j) for i in range(6) for j in range(i)] + [(5000, 5001)] + [(6000 + rng.randrange(60), 6000 + rng.randrange(60)) for _ in range(70)]
    pairs = [(a, b) for a, b in pairs if a != b]
    rng.shuffle(pairs)
    df = frame("a long, b long", *[(min(p), max(p)) for p in pairs]).distinct()
    got = {r["id"]: r["group_id"] for r in connected_groups(df).collect()}
    assert got == brute(pairs)


def test_matches(frame):
    rows = frame(SCHEMA, (" 007", "8", 0.7, "q", 1, 2), ("8", "7", 0.9, "q", 1, 2), ("9", "9 ", 0.9, "", 1, 2), ("1", None, 0.9, "", 1, 2), ("1", "2", None, "", 1, 2), ("x1", "2", 0.9, "", 1, 2), ("3", "4", 0.69, "", 1, 2))
    assert [tuple(r) for r in match_edges(rows).collect()] == [(7, 8)]
    assert {r["id"]: r["group_id"] for r in connected_groups(match_edges(rows)).collect()} == {7: 7, 8: 7}


def test_empty(frame):
    assert connected_groups(match_edges(frame(SCHEMA))).count() == 0
