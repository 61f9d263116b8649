"""The registered queries on the smallest tables, and the pipeline against plain Python."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from skerry.llm import pii, shingles, toxicity
from skerry.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import check_pieces, components_of, plain_hits


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    assert rows
    if name in ORACLES:
        with duckdb.connect() as con:
            for t in ("documents", "benchmark", "conversations"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
            got = con.execute(ORACLES[name])
            names = [c[0] for c in got.description]
            assert sorted(names) == cols
            assert sorted(rows, key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in got.fetchall()), key=repr)


def test_pipeline_equals_plain_python(spark, sf_dir):
    import numpy as np

    from skerry.llm.tokens import encoder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rows = [r for r, s in zip(rows, model.scores([t for _, t in rows]), strict=True) if s < 0.5]
    sets = {k: shingles.exact_set(t, 5) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a > b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = components_of(links, sets)
    rows = [r for r in rows if low[r[0]] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(k, pii.masked(t)) for k, t in rows if not plain_hits(t, items)[1]]
    ids = {k: np.append(encoder().ids(t), np.uint32(0)).astype("<u4") for k, t in rows}
    fill = check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), ids)
    assert all(n == 1024 for k, n in fill.items() if k != max(fill))


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString(), name
