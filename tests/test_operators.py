"""Core operators on small cases, edges included."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.functions import dates, text
from quillstack.operators import copies, filters, graph, mail, quality, references, relations, skew, spans, summaries, upserts, vectors, windows
from quillstack.operators.lineage import scratch

CHUNK = "chunk_id string, sha256 string, processed_at timestamp_ntz, ref_table string, key string, n int"
CONTENT = "id long, source_type string, sha256 string, created_at timestamp_ntz, is_parent boolean"
EMB = "id long, content_id long, created_at timestamp_ntz, stem string"
DAY = datetime(2024, 1, 1)


def found(df):
    return sorted((r["ref_table"], r["ref_id"], r["reason"]) for r in df.collect())


def test_orphans(frame):
    full, other = "a" * 64, "b" * 64
    chunks = frame(CHUNK, ("c1", full.upper(), DAY, "x", "y", 1), ("c2", other, DAY, "x", "y", 1), ("c3", full[:16], None, "x", "y", 1), ("c4", None, DAY, "x", "y", 1), ("c5", "  ", DAY, "x", "y", 1), ("c1", full.upper(), DAY, "x", "y", 1))
    content = frame(CONTENT, (1, "document", f" {full} ", datetime(2024, 1, 5), True), (2, "document", "c" * 64, None, True), (3, "email_message", other, DAY, True), (4, None, None, None, None))
    embeddings = frame(EMB, (7, 1, datetime(2024, 1, 4, 12), "s"), (8, 99, DAY, "s"), (9, None, DAY, "s"), (10, 1, datetime(2024, 1, 1), "s"), (11, 2, DAY, "s"))
    got = found(references.orphans(references.sides_of(chunks, content, embeddings)).distinct())
    assert got == [
        ("content_embeddings", "10", "late"), ("content_embeddings", "8", "missing"), ("content_unified", "2", "missing"),
        ("document_chunks", "c1", "late"), ("document_chunks", "c2", "missing"),
    ]  # c3 has no time of its own; the cut hash is a partner of content 1 without time


def test_orphans_of_empty_tables(frame):
    empty = [frame(s) for s in (CHUNK, CONTENT, EMB)]
    assert references.orphans(references.sides_of(*empty)).count() == 0
    assert references.orphan_report(references.sides_of(*empty)).count() == 0
    some = frame(CHUNK, ("c1", "a" * 64, DAY, "", "", 1))
    assert found(references.orphans(references.sides_of(some, *empty[1:]))) == [("document_chunks", "c1", "missing")]


def test_many_to_one_keeps_hot_rows(frame):
    rows = frame("k string, v int", *[("hot", i) for i in range(500)], *[(f"k{i}", i) for i in range(100)], (None, 1))
    lookup = frame("k string, w int", ("hot", 1), *[(f"k{i}", i) for i in range(0, 100, 2)])
    assert skew.many_to_one(rows, lookup, "k").count() == 550
    assert skew.many_to_one(rows, lookup, "k", "left").count() == 601


def test_scratch_cuts_lineage(spark, frame):
    kept = scratch(spark, "test").keep(frame("a int", (1,), (2,)))
    assert "Scan parquet" in kept._jdf.queryExecution().toString() and kept.count() == 2


def test_filters_compile(frame):
    df = frame("id int, a string, b int", (1, "x", 5), (2, "y", 7), (3, None, 9))
    assert df.where(filters.payload_filter({"a": ["x", "y"], "b": {"gt": 5}})).count() == 1
    assert df.where(filters.payload_filter({})).count() == 3
    assert df.where(filters.structured_filter([{"b": {"lte": 9}}], [{"a": "x"}, {"b": 9}], [{"a": "x"}])).count() == 1


def test_graph(frame):
    edges = frame("src long, dst long, relation string, strength double", (1, 2, "r", 0.9), (2, 3, "r", 0.8), (3, 4, "r", 0.7), (8, 9, "r", 0.7))
    comps = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert comps == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    reach = {r["id"]: r["depth"] for r in graph.breadth_first(edges, frame("id long", (1,)), 2).collect()}
    assert reach == {1: 0, 2: 1, 3: 2}
    paths = graph.simple_paths(edges, 1, 4, 3).collect()
    assert [list(p["path"]) for p in paths] == [[1, 2, 3, 4]]
    assert abs(sum(r["rank"] for r in graph.pagerank(edges).collect()) - 1) < 1e-9
    empty = edges.where("false")
    assert graph.components(empty).count() == graph.pagerank(empty).count() == graph.degrees(empty).count() == 0


def test_windows(frame):
    rows = frame("id long, created_at timestamp_ntz", (1, datetime(2024, 1, 1, 23)), (2, datetime(2024, 1, 1, 23)), (3, datetime(2024, 1, 5)), (4, None))
    got = {r["id"]: r["next_id"] for r in windows.following(rows).collect()}
    assert got == {1: 2, 2: 3, 3: None}
    later = {r["at_second"]: (r["n"], r["later"]) for r in windows.within_seconds(rows, "created_at").collect()}
    assert sorted(later.values()) == [(1, 0), (2, 1)]
    with pytest.raises(ValueError):
        windows.within_seconds(rows, "created_at", 100_000)


def test_vectors_against_numpy(frame):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = frame("id long, vector array<float>", *[(i, [float(v) for v in r]) for i, r in enumerate(x)])
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    got = vectors.nearest(df.where("id < 5"), df, 3).collect()
    for q in range(5):
        assert {r["id"] for r in got if r["query_id"] == q} == set(np.argsort(-sims[q])[:3])
    labels = {r["id"]: r["cluster"] for r in vectors.dense_clusters(df, 0.9, 2).collect()}
    assert len(labels) == 60 and all(c == -1 or c <= i for i, c in labels.items())
    assert vectors.nearest(df.where("false"), df, 3).count() == 0


def test_copies(frame):
    base = "the tenant shall pay the rent on the first day of every month and keep the unit in good repair at all times " * 3
    df = frame("id long, text string, band int", (1, base, 0), (2, base.upper() + "  ", 0), (3, base + "with interest", 0), (4, "something else altogether, nothing alike", 0), (5, None, 0), (6, "", 0))
    exact = copies.exact_copies(df).collect()
    assert [(r["n"], r["first_id"]) for r in exact] == [(2, 1)]
    groups = {r["id"]: r["group_id"] for r in copies.near_copies(df.select("id", "text")).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_spans(frame):
    docs = frame("id long, text string", (1, "Case No. 2020-CA-123456. Nothing herein shall be construed as a waiver of any right."), (2, None))
    got = spans.without_overlaps(spans.find_spans(docs, spans.ENTITY_PATTERNS)).collect()
    assert all(docs.first()["text"][r["start"] : r["end"]] == r["text"] for r in got) and len(got) == 1
    cut = {r["id"]: r["text"] for r in spans.removed(docs, spans.find_spans(docs, spans.BOILERPLATE_PATTERNS)).collect()}
    assert cut == {1: "Case No. 2020-CA-123456.", 2: None}
    parts = frame("id long, start int, end int", (1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 12, 13))
    assert sorted((r["start"], r["end"]) for r in spans.merged(parts).collect()) == [(0, 9), (12, 13)]


def test_sentences():
    assert summaries.sentences("Dr. Ray came. He left at 5. 6 went.") == ["Dr. Ray came.", "He left at 5.", "6 went."]
    assert summaries.ranked_sentences("") == [] and summaries.ranked_sentences(None) == []
    long = "The roof leaks. " * 3000
    assert len(summaries.ranked_sentences(long)) <= 3


def test_chunks_cover_the_text(frame):
    body = "One sentence here. " * 200
    got = mail.chunks(frame("id long, text string", (1, body), (2, ""), (3, None))).orderBy("place").collect()
    assert all(body[r["start"] : r["start"] + len(r["chunk"])] == r["chunk"] for r in got) and got[-1]["start"] + len(got[-1]["chunk"]) == len(body)
    assert all(b["start"] <= a["start"] + len(a["chunk"]) for a, b in zip(got, got[1:])) and {r["id"] for r in got} == {1}


def test_raw_messages(spark):
    import base64
    import json

    body = base64.urlsafe_b64encode("Grüße".encode()).decode()
    raw = {"id": "a", "threadId": "t", "payload": {"headers": [{"name": "subject", "value": "Hi"}, {"name": "Date", "value": "Fri, 5 Jan 2024 10:11:12 +0000"}], "body": {"data": None}, "parts": [{"mimeType": "text/plain", "filename": "", "body": {"data": body, "size": 7}}, {"mimeType": "application/pdf", "filename": "x.pdf", "body": {"data": None, "size": 9}}]}}
    df = spark.createDataFrame([(json.dumps(raw),)], "j string").select(F.from_json("j", mail.RAW).alias("m")).select("m.*")
    r = mail.parsed_messages(df).first()
    assert (r["subject"], r["body"], r["sender"]) == ("Hi", "Grüße", None) and r["sent"].hour == 10
    assert [x["filename"] for x in mail.attachments(df).collect()] == ["x.pdf"]


def test_upserts(frame):
    old = frame("k string, v int", ("a", 1), ("b", 2))
    new = frame("k string, v int", ("b", 3), ("c", 4), ("c", 4))
    assert sorted(map(tuple, upserts.upserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, upserts.inserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    assert upserts.deleted(old, new, ["k"]).count() == 1


def test_files(spark, tmp_path):
    from quillstack.sources import files

    (tmp_path / "a.md").write_text("---\ntitle: x\n---\n# Hello\n")
    (tmp_path / "b").write_bytes(b"plain words")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 \x00\x01")
    (tmp_path / "d.docx").write_bytes(b"PK\x03\x04broken")
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["text"]) for r in files.texts(files.files(spark, str(tmp_path))).collect()}
    assert got["a.md"][0] == "markdown" and got["b"] == ("text", "plain words") and got["c.pdf"] == ("pdf", None) and got["d.docx"] == ("docx", None)


def test_stream_restarts(spark, frame, tmp_path):
    from quillstack.streaming import ingest

    schema = "message_id string, content string, created_at timestamp_ntz"
    row = lambda i: (f"m{i}", "text", DAY)
    frame(schema, row(1), row(2), (None, "x", DAY), ("m3", "", DAY)).write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    ingest.sync_mails(*args)
    frame(schema, row(2), row(4)).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.sync_mails(*args)
    assert sorted(r["message_id"] for r in spark.read.parquet(str(tmp_path / "out/mails")).collect()) == ["m1", "m2", "m4"]
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 2


def test_uuid5_and_dates(frame):
    import uuid

    got = frame("s string", ("email:1",)).select(text.uuid5("s").alias("u")).first()["u"]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_DNS, "email:1"))
    assert dates.relative_date("3 days ago", DAY) == datetime(2023, 12, 29) and dates.relative_date("last month", DAY) == datetime(2023, 12, 1) and dates.relative_date("whenever") is None


def test_near_relations_meet_every_mention_within_reach(frame):
    mentions = frame("message_id string, text string, start int, end int, confidence double", ("m", "A", 0, 5, 0.9), ("m", "B", 10, 130, 0.9), ("m", "C", 12, 20, None), ("m", "D", 105, 110, 0.9), ("m", "E", 231, 240, 0.9), ("m", "F", 230, 231, 0.9), ("o", "G", 10, 12, 0.9), ("m", "H", None, None, 0.9))
    mails = frame("message_id string, content string", ("m", "x" * 300), ("o", "y"))
    got = {(r["source"], r["target"]) for r in relations.near_relations(mentions, mails).collect()}
    parts = [("A", 0, 5), ("B", 10, 130), ("C", 12, 20), ("D", 105, 110), ("F", 230, 231), ("E", 231, 240)]
    assert got == {(a, b) for i, (a, _, e) in enumerate(parts) for b, s, _ in parts[i + 1 :] if s - e <= 100}
    assert {("A", "C"), ("B", "C"), ("A", "D"), ("B", "F")} <= got and ("B", "E") not in got


def test_ward_clusters_of_a_large_label_are_whole(spark):
    df = spark.range(4500).selectExpr("id", "1 as label", "array(float(id % 3 * 9), float(id % 7 / 1e5)) as vector")
    got = {r["id"]: r["cluster"] for r in relations.ward_clusters(df, "label", 1.2).collect()}
    assert got == {i: i % 3 for i in range(4500)}


def test_ward_labels_against_the_matrix():
    def by_matrix(x, cut):
        groups = [[i] for i in range(len(x))]
        far = lambda a, b: np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        while len(groups) > 1:
            d, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if d > cut:
                break
            groups[i] += groups.pop(j)
        return [min(g) for i in range(len(x)) for g in groups if i in g]

    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 30):
        x = rng.normal(size=(n, 3))
        for cut in (0.5, 1.2, 3.0):
            assert relations.ward_labels(x.copy(), cut).tolist() == by_matrix(x, cut)


def test_near_copies_of_a_large_band(frame):
    """Letters on one template, which alone is what two near ones and 138 others share."""
    body = " ".join(f"t{k}" for k in range(204))
    letter = lambda i, n: body + "".join(f" u{i}x{k}" for k in range(n))
    rows = [(i, letter(i, 24 if i in (10, 90) else 30)) for i in range(140)]
    alike = lambda a, b: len(a & b) / len(a | b)
    sets = [set(copies.shingles(t).tolist()) for _, t in rows]
    assert [(i, j) for i in range(140) for j in range(i) if alike(sets[i], sets[j]) >= copies.NEAR] == [(90, 10)]
    groups = {r["id"]: r["group_id"] for r in copies.near_copies(frame("id long, text string", *rows)).collect()}
    assert groups == {i: 10 if i == 90 else i for i in range(140)}


def test_a_long_text_is_ranked_as_a_whole():
    """The sentence that links the second half of the text stands alone in the first thousand."""
    hub = "Roof and cellar."
    long = [hub, *[f"Garden garden g{i}x." for i in range(999)], *[f"{w} {w} r{i}x." for i in range(500) for w in ("Roof", "Cellar")]]
    assert summaries.ranked_sentences("\n".join(long))[0] == hub


def test_pagerank_converges(frame):
    edges = [(a, b) for a in range(12) for b in (a * 5 % 12, (a + 1) % 12) if a != b and a != 7]
    nodes = sorted({x for e in edges for x in e})
    rank, n_out = {v: 1 / len(nodes) for v in nodes}, {v: sum(a == v for a, _ in edges) for v in nodes}
    for _ in range(300):
        rank = {v: 0.15 / len(nodes) + 0.85 * sum(rank[a] / n_out[a] for a, b in edges if b == v) for v in nodes}
    got = {r["id"]: r["rank"] for r in graph.pagerank(frame("src long, dst long", *edges), rounds=100, epsilon=1e-9).collect()}
    assert set(got) == set(nodes) and all(abs(got[v] - rank[v] / sum(rank.values())) < 1e-6 for v in nodes)
    assert graph.pagerank(frame("src long, dst long"), rounds=100, epsilon=1e-4).count() == 0


def test_hot_keys_named_or_counted(frame):
    rows = frame("k long, v long", *[(None if i % 50 == 0 else 1 if i % 3 else i, i) for i in range(300)])
    lookup = frame("k long, name string", *[(i, f"n{i}") for i in range(0, 300, 2)], (1, "n1"))
    want = sorted((r["v"], r["name"]) for r in rows.join(lookup, "k", "left").collect())
    for hot in (None, [], [1], [1, 5]):
        assert sorted((r["v"], r["name"]) for r in skew.many_to_one(rows, lookup, "k", "left", hot=hot).collect()) == want
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert skew.hot_list(counts, "k", 300) == [] and skew.hot_list(counts, "k", 300, least=10) == [1]


def test_numbers_in_time(frame):
    rows = frame("id long, at timestamp_ntz", *[(i, None if i == 9 else datetime(2022, 12, 31, 22) + timedelta(minutes=(i * 37) % 500 // 10 * 10)) for i in range(60)])
    got = {r["id"]: r["n"] for r in windows.ranked_in_time(rows, "at", ["id"], "n").collect()}
    order = sorted(rows.collect(), key=lambda r: (r["at"] or datetime.min, r["id"]))
    assert got == {r["id"]: k + 1 for k, r in enumerate(order)}
    eids = {r["id"]: r["eid"] for r in windows.numbered(rows.where("at is not null"), "at", ["id"]).collect()}
    assert sorted(eids.values())[0] == "EID-2022-0001" and len(set(eids.values())) == 59


def test_quality_gates_of_blank_texts(frame):
    rows = quality.gated(frame("id long, text string, score string", (1, None, ""), (2, "  ", ""), (3, "the " * 10, "")).drop("score")).collect()
    assert [(r["score"], r["reasons"]) for r in rows[:2]] == [(0.0, "empty_text")] * 2 and "low_bigram_diversity" in rows[2]["reasons"]


def test_late_rows_of_a_stream(spark, frame, tmp_path):
    """Rows later than the watermark are left out, others are added to the windows they belong to."""
    from quillstack.streaming import ingest

    schema, folder = "ts timestamp_ntz, kind string", str(tmp_path / "in")
    batches = [[(DAY, "a"), (DAY + timedelta(days=40), "a")], [(DAY + timedelta(days=41), "a")], [(DAY + timedelta(days=1), "a"), (DAY + timedelta(days=30), "a")]]
    for rows in batches:
        frame(schema, *rows).coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.windowed_counts(ingest.arriving(spark, folder, schema), "ts", "kind", late="20 days")
        ingest.run_available(stream, ingest.updates(str(tmp_path / "out")), str(tmp_path / "state"), "update")
    got = ingest.latest_updates(spark, str(tmp_path / "out"), ["window_start", "kind"])
    assert got.agg({"n": "sum"}).first()[0] == 4


def test_vectors_by_a_given_model(frame):
    from quillstack.operators import encode

    def load():
        return lambda texts: [[len(t), t.count("a"), 1.0] for t in texts]

    rows = frame("id long, text string, vector int", *[(i, "a" * i, 0) for i in range(1, 600)], (1000, None, 0), (1001, "  ", 0))
    got = {r["id"]: r["vector"] for r in encode.encoded(rows, load, 3).collect()}
    assert got[1000] is None and got[1001] is None and all(got[i] == [i, i, 1.0] for i in range(1, 600))
    with pytest.raises(Exception, match="the model gave"):
        encode.encoded(rows, load, 4).collect()
    assert encode.encoded(rows.where("false"), load, 3).count() == 0
