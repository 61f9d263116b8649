"""Queries over whole tables: nothing is left out of their results."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import graph, palette
from skerry.plans import catalog_search
from skerry.plans.catalog import QUERIES
from skerry.plans.catalog_search import DF
from skerry.plans.catalog_text import TERMS_OF_TEXT
from skerry.plans.views import NOTES, TERMS, events


def rows_of(sql, sf_dir, *tables):
    with duckdb.connect() as con:
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return con.execute(sql).fetchall()


def test_pair_similarity_of_all_neighbours(spark, sf_dir):
    files = {}
    for k, v in rows_of("SELECT vec_id, embedding FROM embeddings", sf_dir, "embeddings"):
        v = np.array(v, float)
        files.setdefault(k // 4, []).append(v / np.linalg.norm(v))
    expected = {(a, a + 1): max(float(x @ y) for x in files[a] for y in files[a + 1]) for a in files if a + 1 in files}
    got = {(r.a, r.b): r.similarity for r in QUERIES["max_pair_similarity"](spark, sf_dir).collect()}
    assert got.keys() == expected.keys() and any(a >= 40 for a, _ in got)
    assert all(abs(got[k] - expected[k]) < 2e-6 for k in got)


@pytest.mark.parametrize("order", [("pinned", "recent"), ("recent", "pinned"), ()])
@pytest.mark.parametrize("times", [1, 7, 5000])
def test_every_item_has_its_place(spark, order, times):
    n = 3000
    used = F.when(F.col("id") % 3 != 0, F.timestamp_seconds(F.col("id") * 7919 % times))
    items = spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), (F.col("id") % 5 == 0).alias("is_pinned"), used.alias("last_used"))
    got = {r.id: (r.group, r.place) for r in palette.sorted_items(items, order, slots=8).collect()}
    rows = []
    for i in range(n):
        t = i * 7919 % times if i % 3 else None
        is_in = {"pinned": i % 5 == 0, "recent": t is not None}
        group = next((k for k, name in enumerate(order) if is_in[name]), len(order))
        rows.append((group, t is None, -(t or 0), -i, str(i)))
    assert got == {r[-1]: (r[0], k) for k, r in enumerate(sorted(rows), 1)}


def test_sorted_items_and_commands_list_all(spark, sf_dir):
    items = rows_of("SELECT CAST(p_partkey AS VARCHAR), p_name FROM part", sf_dir, "part")
    many = "/root/testdata/sf0.01"
    assert QUERIES["palette_sorted_items"](spark, many).count() == rows_of("SELECT count(*) FROM part", many, "part")[0][0]
    assert [tuple(r) for r in QUERIES["commands"](spark, sf_dir).collect()] == sorted(items, key=lambda x: (x[1], x[0]), reverse=True)


def test_density_of_every_document(spark, sf_dir):
    df, n = (rows_of(f"WITH {DF} SELECT {x}", sf_dir, "documents") for x in ("term, df FROM df", "n FROM n"))
    weights = {t: max(0.0, float(np.log((n[0][0] + 1) / (dict(df).get(t, 0) + 1)))) for t in TERMS}
    texts = rows_of("SELECT doc_id, lower(text) FROM documents", sf_dir, "documents")
    expected = {i: sum(w * min(x.count(t) / 5, 1) for t, w in weights.items()) / sum(weights.values()) for i, x in texts}
    got = {r.id: r.density for r in QUERIES["content_density"](spark, sf_dir).collect()}
    assert got == pytest.approx(expected, abs=2e-6) and min(got.values()) == 0


def test_link_candidates_of_all_sources(spark, sf_dir):
    paths = {(p, False) for (p,) in rows_of(f"WITH {NOTES} SELECT path FROM notes", sf_dir, "documents")} - {("src1/en/1.md", False)}
    got = [(r.path, r.is_unresolved) for r in QUERIES["link_candidates"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == paths | {("missing note", True), ("other note", True)}


def test_synonyms_of_all_terms(spark, sf_dir):
    terms = {t for (t,) in rows_of(f"SELECT DISTINCT unnest({TERMS_OF_TEXT}) FROM documents", sf_dir, "documents")}
    pairs = [("the", "der"), ("the", "les"), ("and", "und")]
    more = {(b, a) for x in pairs for a, b in (x, x[::-1]) if a in terms}
    got = {(r.term, r.query_term) for r in QUERIES["synonyms"](spark, sf_dir).collect()}
    assert terms and got == {(t, t) for t in terms} | more


def test_whole_texts_are_highlighted(spark, sf_dir):
    texts = rows_of("SELECT doc_id, text FROM documents", sf_dir, "documents")
    expected = {i: re.sub("(?i)(the|th)", r"<mark>\1</mark>", x) for i, x in texts}
    got = {r.id: r.marked for r in QUERIES["highlighted"](spark, sf_dir).collect()}
    assert got == expected and any("<mark>" in x[400:] for x in got.values())


def test_hybrid_ranks_are_those_of_production(spark, sf_dir):
    ranks = graph.page_rank(graph.click_edges(events(spark, sf_dir)), rounds=20, epsilon=1e-4)
    expected = {int(r.path): r.page_rank for r in ranks.collect()}
    signals = catalog_search._corpus(spark, sf_dir).signals.where("page_rank is not null").collect()
    assert signals and {r.id: r.page_rank for r in signals} == pytest.approx({r.id: expected[r.id] for r in signals}, abs=1e-9)
