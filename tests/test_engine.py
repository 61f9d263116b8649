"""Operators on small fixtures, streams against batches, and queries against SQL."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from skerry.operators import graph, index, maintenance, palette, ranking, telemetry, usage
from skerry.plans import query as Q
from skerry.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
T0 = datetime(2024, 1, 1)


def shown(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(shown(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted((tuple(shown(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        got = con.execute(ORACLES[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        expected = sorted((tuple(shown(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert rows == expected


@pytest.mark.parametrize(("edges", "nodes", "ranks"), [
    ([("A", "C"), ("B", "C"), ("C", "A")], "ABC", {"A": 0.97690006, "B": 0.10404737, "C": 1.0}),
    ([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")], "ABCD", {"A": 0.97582381, "B": 0.54065233, "C": 1.0, "D": 0.12582381}),
])
def test_page_rank(spark, edges, nodes, ranks):
    e = spark.createDataFrame(edges, "src string, dst string")
    v = spark.createDataFrame([(n,) for n in nodes], "path string")
    got = {r.path: r.page_rank for r in graph.page_rank(e, v, epsilon=None if len(nodes) == 3 else 1e-4).collect()}
    assert got == pytest.approx(ranks, abs=1e-6)
    assert max(got.values()) == 1


def test_page_rank_of_nothing(spark):
    assert graph.page_rank(spark.createDataFrame([], "src string, dst string")).count() == 0


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), "u", k, p) for i, (s, k, p) in enumerate(rows)], "event_id long, ts timestamp, user string, kind string, path string")


SEQUENCE = [(0, "click", "A"), (1, "click", "B"), (5.9, "view", "x"), (6, "view", "x"), (10, "click", "C"), (15, "view", "x")]


def test_bounces(spark):
    found = usage.bounces(events(spark, SEQUENCE)).collect()
    assert [(r.path, r.after) for r in found] == [("B", 4.9)]


def test_bounce_stream_equals_batch(spark, tmp_path):
    from skerry.streaming.events import bounce_stream

    e = events(spark, SEQUENCE)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = bounce_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bounces").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.path, round(r.after, 6)) for r in spark.table("bounces").collect()] == [("B", 4.9)]


def test_bursts_stream_equals_batch(spark, tmp_path):
    from skerry.streaming.events import burst_stream

    rows = [(i, T0 + timedelta(seconds=s), "a" if s < 100 else "b", op) for i, (s, op) in enumerate([(0, "create"), (0.5, "modify"), (5, "delete"), (200, "create"), (200.9, "modify"), (3000, "create")])]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, path string, op string")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = burst_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), late="0 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.path, r.n, r.op) for r in spark.table("bursts").collect()}
    batch = {(r.path, r.n, r.op) for r in maintenance.debounced(e, 1.0).collect()}
    assert got <= batch and {("a", 2, "modify"), ("a", 1, "delete"), ("b", 2, "modify")} <= got


def test_latency_rule(spark):
    rows = [(i, T0 + timedelta(seconds=i), "search", float(i)) for i in range(1, 11)]
    r = telemetry.latency_stats(spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, ms double")).first()
    assert (r.median, r.p95, r["max"], r.n) == (6, 10, 10, 10)


def test_health(spark):
    assert spark.range(1).select(telemetry.health(F.lit(300.0), F.lit(1500.0), F.lit(0.0)).alias("h")).first().h == 75


@pytest.mark.parametrize(("q", "hit"), [("#a", True), ("#a/b", True), ("#ab", False)])
def test_tag(spark, q, hit):
    row = spark.createDataFrame([(["#a/b"],)], "tags array<string>")
    assert row.select(palette.has_tag(F.col("tags"), [q]).alias("h")).first().h == hit


def test_keyword_search_needs_all_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (2, "alpha", "beta gamma"), (3, "alpha", "y"), (4, "alphabet", "betas")], "id long, title string, content string")
    post = index.postings(docs)
    ids = lambda **k: {r.id for r in index.keyword_search(post, 4, ["alpha", "beta"], **k).collect()}
    assert ids(prefix=False, tolerance=0) == {1, 2}
    assert ids(prefix=True, tolerance=0) == {1, 2, 4}
    assert ids(prefix=False, tolerance=1) == {1, 2}


def test_leader_clusters(spark):
    page = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "path string, rank int")
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.1, 0.9])], "path string, embedding array<double>")
    got = {r.path: (r.cluster_id, r.is_primary, r.cluster_size) for r in ranking.leader_clusters(page, chunks, 0.85).collect()}
    assert got == {"a": (0, True, 2), "b": (0, False, 2), "c": (1, True, 2), "d": (1, False, 2)}
    assert {r.path for r in ranking.primaries(page, chunks, True, 0.85).collect()} == {"a", "c"}
    assert ranking.primaries(page, chunks, False).count() == 4


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 2, 0.5)], "path string, rank int, normalized double")
    b = spark.createDataFrame([("y", 1, 1.0), ("z", 2, 0.5)], "path string, rank int, normalized double")
    one = {r.path: r.fusion for r in ranking.fuse(a, b).collect()}
    two = {r.path: r.fusion for r in ranking.fuse(b, a).collect()}
    assert one == pytest.approx(two)


def test_store(spark, tmp_path):
    from skerry.sources.store import Store

    s = Store(spark, f"file://{tmp_path}/store")
    rows = lambda *r: spark.createDataFrame(r, "id string, v int")
    assert s.read("content") is None
    s.put("content", rows(("a", 1), ("b", 2)))
    s.put("content", rows(("b", 3), ("c", 4)))
    assert {(r.id, r.v) for r in s.read("content").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    s.delete(rows(("a", 0)))
    assert {r.id for r in s.read("content").collect()} == {"b", "c"}
    s.clear()
    assert s.read("content") is None


def test_notes(spark, tmp_path):
    from skerry.sources.notes import link_table, read_notes

    (tmp_path / "a.md").write_text("---\ntitle: Alpha note\naliases: [One, Two]\nrating: 4\n---\n# Head\nsee [[b|the b]] and [[nope]] #tag/x\n")
    (tmp_path / "b.md").write_text("plain")
    notes = read_notes(spark, f"file://{tmp_path}").cache()
    a = notes.where("title = 'Alpha note'").first()
    assert (a.headings, a.links, a.link_texts, a.aliases, a.tags, a.frontmatter["rating"]) == (["Head"], ["b", "nope"], ["the b"], ["One", "Two"], ["#tag/x"], ["4"])
    assert [r.target for r in graph.unresolved(link_table(notes), notes).collect()] == ["nope"]
    assert graph.resolve_links(link_table(notes), notes).count() == 1
    assert {r.phrase for r in Q.phrase_lexicon(notes).collect()} == {"the b"}


def test_macros(spark, sf_dir):
    m = palette.Macros(known=QUERIES)
    m.add("two", ["store_stats", "index_stats"])
    m.add("bad", ["none"])
    assert m.available("two") and not m.available("bad")
    assert [d.count() for d in m.run("two", spark, sf_dir)] == [1, 1]
    m.remove("bad")
    assert list(m.lists) == ["two"]


def test_index_stream(spark, tmp_path):
    from skerry.sources.store import Store
    from skerry.streaming.events import index_writer

    rows = [(1, T0, "create", "a", None, "one"), (2, T0 + timedelta(seconds=1), "modify", "a", None, "two"), (3, T0, "create", "b", None, "x"), (4, T0 + timedelta(seconds=2), "delete", "b", None, None)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, op string, path string, old_path string, content string")
    s = Store(spark, f"file://{tmp_path}/store")
    index_writer(s, lambda d: d.select(F.col("path").alias("id"), "content"))(e, 0)
    assert [(r.id, r.content) for r in s.read("content").collect()] == [("a", "two")]


def test_updated_document_frequencies(spark):
    pairs = lambda *r: spark.createDataFrame(r, "id long, term string")
    df = spark.createDataFrame([("a", 2), ("b", 1)], "term string, df long")
    got = {r.term: r.df for r in maintenance.updated_df(df, pairs((1, "a"), (1, "b")), pairs((1, "a"), (1, "c"))).collect()}
    assert got == {"a": 2, "c": 1}


def test_idf_weights_fall_back_to_even(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5)], "term string, df long")
    got = [r.weight for r in index.idf_weights(df, ["a", "b"], 5).collect()]
    assert got == [0.5, 0.5] and not math.isnan(got[0])
