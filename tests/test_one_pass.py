"""Back-test, recurrences and warnings look at their input once."""

import datetime as dt
import random

import pytest

from verdant.operators import backtest as B
from verdant.operators import portfolio as P

D = [dt.date(2024, 1, k) for k in range(1, 9)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    rows = [(p, d, f"S{s}", rnd.random()) for p in (1, 2, None) for d in D for s in range(4) if rnd.random() < 0.5]
    weights = spark.createDataFrame(rows, "portfolio_id bigint, date date, symbol string, weight double")
    returns = spark.createDataFrame([(f"S{s}", D[k], rnd.uniform(-.1, .1)) for s in range(3) for k in (1, 3, 4, 6)], "symbol string, date date, ret double")
    return rows, weights, returns, spark.createDataFrame([("S0", 0.9)], "symbol string, esg_unit double")


def test_ledger_reads_the_weights_once_and_adds_up(tables):
    rows, weights, returns, esg = tables
    led = B.backtest_ledger(weights, returns, esg, 100)
    assert _plan(led).count("weight#") and _plan(led).count("LogicalRDD [portfolio_id") == 1
    ret = {(r.symbol, r.date): r.ret for r in returns.collect()}
    days = sorted({d for _, d in ret})
    for r in led.collect():
        mine = {s: w for p, d, s, w in rows if (p, d) == (r.portfolio_id, r.date)}
        after = next(d for d in days if d > r.date)
        assert r.port_return == pytest.approx(sum(w * ret.get((s, after), 0) for s, w in mine.items()))
        assert r.esg == pytest.approx(sum(w * (0.9 if s == "S0" else 0.5) for s, w in mine.items()))
        held = sorted({d for p, d, _, _ in rows if p == r.portfolio_id})
        before = [d for d in held if d < r.date]
        names = {s for p, _, s, _ in rows if p == r.portfolio_id}
        old = {s: w for p, d, s, w in rows if (p, d) == (r.portfolio_id, before[-1])} if before else dict.fromkeys(names, 1 / len(names))
        want = sum(abs(mine.get(s, 0) - old.get(s, 0)) for s in names)
        assert r.turnover == (None if r.portfolio_id is None else pytest.approx(want))
    assert {(r.portfolio_id, r.date) for r in led.collect()} == {(p, d) for p, d, _, _ in rows if d < days[-1]}


def test_recurrences_in_short_batches_and_without_key(spark):
    rows = [(p, D[k], 0.01 * (k - 3)) for p in (1, 2) for k in range(8)] + [(None, D[0], 0.1), (None, D[1], 0.2)]
    df = spark.createDataFrame(rows, "portfolio_id bigint, date date, port_return double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.portfolio_id, r.date): r.return_to_go for r in B.differential_sharpe(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p, d, x in rows:
        later = [(y, (e - d).days) for q, e, y in rows if q == p and e >= d] if p else [(x, 0)]
        assert got[p, d] == pytest.approx(sum(y * 0.99 ** k for y, k in later))


def test_warnings_read_the_holdings_once(spark):
    rows = [(1, "A", "X", .5, .5, 20.0), (1, "B", None, .5, .5, 30.0)]
    a = spark.createDataFrame(rows, "portfolio_id bigint, symbol string, sector string, raw_weight double, weight double, esg double")
    out = P.portfolio_warnings(a)
    assert _plan(out).count("LogicalRDD") == 1
    assert sorted(r.message for r in out.collect()) == [
        "A weight (50%) exceeds 12% limit", "B weight (50%) exceeds 12% limit", "Low diversification: only 1 sector(s)",
        "Low portfolio ESG score (25.0)", "X sector (50%) exceeds 35% limit"]
