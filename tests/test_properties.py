"""Invariants of the operators on the sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

from conftest import SF_SMALL


def q(spark, name):
    return E.queries()[name](spark, SF_SMALL)


def test_projected_weights_nonnegative_and_sum_to_one(spark):
    df = q(spark, "h1_projected_holdings")
    assert df.where(F.col("weight") < 0).count() == 0
    sums = df.groupBy("portfolio_id").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0, abs=1e-5) for r in sums)


def test_drawdowns_in_range(spark):
    m = q(spark, "e10_computed_metrics")
    assert m.where((F.col("max_drawdown") < -1) | (F.col("max_drawdown") > 0)).count() == 0
    led = q(spark, "h10_backtest_ledger")
    assert led.where((F.col("drawdown") < -1) | (F.col("drawdown") > 0)).count() == 0


def test_percentile_in_unit_interval(spark):
    m = q(spark, "e10_computed_metrics").where(F.col("sector_rank_pct").isNotNull())
    assert m.where((F.col("sector_rank_pct") <= 0) | (F.col("sector_rank_pct") > 1)).count() == 0


def test_pareto_is_non_dominated(spark):
    front = q(spark, "g6_pareto_frontier").collect()
    for a in front:
        for b in front:
            if a.symbol != b.symbol:
                assert not (b.sharpe >= a.sharpe and b.esg >= a.esg and (b.sharpe > a.sharpe or b.esg > a.esg))


def test_chunks_keep_every_word(spark, tables):
    import regex
    chunks = q(spark, "a7_document_chunks")
    docs = tables.raw("documents").select("doc_id", "text")
    word = regex.compile(r"[\p{L}\p{N}]+")
    got = {}
    for r in chunks.collect():
        got.setdefault(r.doc_id, set()).update(word.findall(r.text))
    for r in docs.collect():
        assert set(word.findall(r.text)) == got.get(r.doc_id, set())


def test_chunk_sizes_bounded_except_long_sentences(spark):
    c = q(spark, "a7_document_chunks")
    assert c.count() > 0
    assert c.where(F.col("n_tokens") <= 0).count() == 0


def test_search_top_k_bounds(spark):
    for name in ("i4_semantic_search", "i5_keyword_search", "i7_ivf_search"):
        df = q(spark, name)
        assert df.groupBy("query_id").count().where(F.col("count") > 5).count() == 0


def test_ivf_with_all_lists_probed_is_exact(spark, tables):
    from verdant.operators import search as S
    from verdant.plans.queries_search import _knowledge, _label_centroids
    kb = _knowledge(tables).where(F.col("vec").isNotNull())
    index = S.ivf_build(kb.select("doc_id", "vec"), "doc_id", lists=8)
    approx = {(r.query_id, r.doc_id) for r in
              S.ivf_search(index, _label_centroids(tables), "doc_id", k=5, probes=index.lists).collect()}
    exact = {(r.query_id, r.doc_id) for r in q(spark, "i4_semantic_search").collect()}
    assert approx == exact


def test_nearest_is_the_same_whatever_the_size_of_the_blocks(spark, tables, monkeypatch):
    from verdant.operators import search as S
    from verdant.operators import vectors as V
    e = tables.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    q = e.where("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    whole = S.nearest(e, q, 4, "doc_id", "query_id", exclude_self=True)
    first = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(V, "BLOCK_BYTES", 5 * 8 * 64)
    assert sorted(map(tuple, S.nearest(e, q, 4, "doc_id", "query_id", exclude_self=True).collect())) == first
    assert whole.count() == 4 * q.count() and whole.where("query_id = doc_id").count() == 0


def test_price_fields_are_read_once(spark):
    from verdant.operators import ingest as A
    rec = spark.createDataFrame([(1, {"symbol": "A", "date": "2024-01-02", "open": "1", "close": "x"}, 5),
                                 (2, {"symbol": "B", "date": "2024-01-02", "open": "0", "close": "2"}, 6)],
                                "id int, record map<string,string>, _read int")
    typed, bad = A.split_prices(rec)
    assert typed.columns == ["id", "_read", "symbol", "date", "open", "high", "low", "close", "volume"]
    assert [(r.id, r._read, r.open, r.close) for r in typed.collect()] == [(2, 6, None, 2.0)]
    assert bad.columns == ["id", "_read", "record", "reject_reason"] and bad.first().reject_reason == "unreadable_close"
    plan = A.validate_prices(typed, "2100-01-01").where("status = 'valid'")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("[close]" in line for line in plan.splitlines()) == 1        # no filter or projection reads the record again
