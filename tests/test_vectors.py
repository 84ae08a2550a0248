"""Block-wise nearest neighbours against all pairs, and the recall of the inverted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.operators import search as S
from verdant.operators import vectors as V


def _data(n, dim, seed, queries):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, dim))
    x[: n // 3] = centres[0] + 0.01 * rng.normal(size=(n // 3, dim))              # a third lies together
    x[5], x[6], x[7] = x[4], 2.5 * x[4], 0.0                                      # ties and a zero vector
    q = np.concatenate([x[rng.integers(0, n, queries // 2)], rng.normal(size=(queries - queries // 2, dim))])
    return x, q


def _brute(x, q, k, keys, q_keys, exclude):
    out = {}
    norms = np.sqrt((x * x).sum(1))
    for i, v in enumerate(q):
        n = np.sqrt((v * v).sum())
        if n == 0:
            continue
        d = [(1 - (x[j] * v).sum() / (norms[j] * n), keys[j]) for j in range(len(x)) if norms[j] > 0 and not (exclude and keys[j] == q_keys[i])]
        out[q_keys[i]] = sorted(d)[:k]
    return out


def _frame(spark, keys, vectors, name):
    return spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, vectors)], f"{name} string, vec array<double>").repartition(3)


@pytest.mark.parametrize("n,dim,queries,k,block", [(400, 6, 60, 5, 2000), (90, 3, 300, 7, 1 << 20), (3, 4, 5, 5, 1 << 20)])
def test_against_all_pairs(spark, monkeypatch, n, dim, queries, k, block):
    monkeypatch.setattr(V, "BLOCK_BYTES", block)
    x, q = _data(max(n, 9), dim, n, queries)
    x = x[:n]
    keys, q_keys = [f"c{j:04d}" for j in range(n)], [f"q{j:04d}" for j in range(len(q))]
    corpus = _frame(spark, keys, x, "symbol").unionByName(spark.createDataFrame([("null", None)], "symbol string, vec array<double>"))
    got = {}
    for r in S.nearest(corpus, _frame(spark, q_keys, q, "query_id"), k, "symbol", "query_id").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.symbol)
    want = _brute(x, q, k, keys, q_keys, False)
    assert set(got) == set(want)
    for i, best in want.items():
        mine = [got[i][r] for r in sorted(got[i])]
        assert np.allclose([d for d, _ in mine], [d for d, _ in best], atol=1e-9), i
        for (d1, s1), (d2, s2) in zip(mine, best):
            assert s1 == s2 or abs(d1 - d2) < 1e-9


def test_itself_left_out_and_the_plan_stays(spark):
    x, _ = _data(200, 5, 2, 2)
    keys = [f"c{j:04d}" for j in range(200)]
    corpus = _frame(spark, keys, x, "symbol")
    plans = []
    for m in (10, 200):
        refs = _frame(spark, keys[:m], x[:m], "ref_symbol")
        top = S.nearest(corpus, refs, 3, "symbol", "ref_symbol", exclude_self=True)
        rows = top.collect()
        assert all(r.symbol != r.ref_symbol for r in rows)
        want = _brute(x, x[:m], 3, keys, keys[:m], True)
        assert {r.ref_symbol for r in rows} == set(want) and len(rows) == 3 * len(want)
        for r in rows:
            assert abs(r.distance - want[r.ref_symbol][r["rank"] - 1][0]) < 1e-9
        plans.append(top._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert plans[0] == plans[1]


def test_empty_sides(spark):
    none = spark.createDataFrame([], "symbol string, vec array<double>")
    one = spark.createDataFrame([("a", [1.0, 2.0])], "query_id string, vec array<double>")
    assert S.nearest(none, one, 3, "symbol", "query_id").collect() == []
    full = spark.createDataFrame([("a", [1.0, 2.0])], "symbol string, vec array<double>")
    assert S.nearest(full, one.limit(0), 3, "symbol", "query_id").collect() == []


def test_recall_of_the_inverted_lists(spark, monkeypatch):
    from verdant.operators import inverted as I
    monkeypatch.setattr(I, "PIECE_ROWS", 60)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    corpus = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    index = S.ivf_build(corpus, "doc_id")
    n = corpus.count()
    assert index.lists >= n / S.IVF_LIST_ROWS and index.rows.count() == n
    assert index.rows.groupBy("list_id", "piece").count().agg(F.max("count")).first()[0] < 120     # long lists are split
    found = {(r.query_id, r.doc_id) for r in S.ivf_search(index, queries, "doc_id", k=5).collect()}
    exact = {(r.query_id, r.doc_id) for r in S.nearest(corpus, queries, 5, "doc_id", "query_id").collect()}
    assert len(exact) == 5 * queries.count() and len(found & exact) / len(exact) >= 0.9
    few = spark.createDataFrame([], "doc_id bigint, vec array<double>")
    assert S.ivf_search(S.ivf_build(few, "doc_id"), queries, "doc_id").collect() == []


def test_norms_are_worked_out_once_a_row(spark):
    from verdant.operators import search as S
    df = S.with_norm(spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], "id int, vec array<double>")).select("id", S._unit("vec", "_norm"))
    assert "/ sqrt(" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [tuple(r) for r in df.collect()] == [(1, [0.6, 0.8])]
