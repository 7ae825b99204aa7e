import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logquill.llm import packing, queries, topk
from tests.llm.test_text import brute_components


def brute(rows, k=5):
    """The k best of every query among (id, integer vector) rows, each but itself."""
    out = []
    for n, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i, m) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i, _) in enumerate(scores[:k])]
    return sorted(out)


def test_search_equals_sql(spark, sf):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        want = sorted(con.execute(queries.ORACLE_SQL["op4_exact_topk"]).fetchall())
    assert sorted(map(tuple, queries.op4_exact_topk(spark, sf).collect())) == want


def test_search_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 40)
    monkeypatch.setattr(topk, "FEW", 6)
    rng = np.random.default_rng(2)
    rows = {i: [float(x) for x in rng.normal(0, 0.2, 8)] for i in range(200)}
    for i in range(100, 140):
        rows[i] = rows[100]
    rows[3] = [0.1, float("nan"), *[0.0] * 6]
    rows[4] = [float("inf")] * 8
    rows[5] = [1.0, 2.0]
    rows[50] = [3.0, -1.0]
    table = [(i, v, None, "x") for i, v in rows.items()] + [(700, None, 1, "y"), (701, [None, 1.0], 1, None), (None, [0.0] * 8, 1, None), (7, rows[7], 2, None)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, v string")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in [*rows.items(), (7, rows[7])] if np.isfinite(v).all()]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(good)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(df, F.col("vec_id") < 0).collect() == []


@pytest.mark.parametrize("large", [1e5, 1e9, 1e12])
def test_search_of_large_components_and_repeated_rows(spark, monkeypatch, large):
    monkeypatch.setattr(topk, "TILE", 50)
    monkeypatch.setattr(topk, "FEW", 6)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(120)]
    rows[17] = (17, [large, -large, 3.0, 0.0, 0.5, 0.0])
    rows[50] = (50, [large / 3, large, -1.0, 0.0, 0.0, 0.0])
    rows += [(100, rows[20][1]), (100, rows[100][1]), (30, rows[31][1]), (130, []), (150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    longest = 2**63 - 1
    want = sorted((q, r, i, max(-longest - 1, min(longest, s))) for q, r, i, s in brute(good))
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == want


def test_scan_stops_on_proof_only():
    rng = np.random.default_rng(9)
    ids, vectors = np.arange(500), rng.integers(-80, 80, (500, 16))
    for q, v, s in topk.best_of_tile(ids, vectors, ids[:40], vectors[:40]):
        want = vectors[:40] @ vectors.T
        for a in np.unique(q):
            order = sorted((-want[a, i], i) for i in ids if i != a)[:5]
            assert [(-x, i) for x, i in zip(s[q == a], v[q == a])] == order


@pytest.fixture(scope="session")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        out.append((before, docs))
    return out


def test_stages(spark, sf, stages):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])
    (docs, good), (_, unique), (_, clean), (_, packed) = stages
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert sum(k in kept for k, q in labels.items() if q) >= 0.95 * sum(labels.values())
    assert sum(k in kept for k, q in labels.items() if not q) <= 0.05 * sum(not q for q in labels.values())  # junk goes
    want = {k for k, (_, c) in brute_components({r["doc_id"]: r["text"] for r in good.collect()}).items() if k == c}
    assert {r["doc_id"] for r in unique.collect()} == want
    assert clean.count() == unique.count()
    assert {r["doc_id"] for r in packed.collect()} == want


def test_run_gives_the_last_stage(spark, sf, stages):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == stages[-1][1].columns and rows.count() == stages[-1][1].count()


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert docs.columns == [f.split()[0] for f in packing.PLACED.split(", ")]
