"""Incremental recompute (K4): states merge like whole histories, batches read only what they restate."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verdant.functions import segments as G
from verdant.operators import metrics as M
from verdant.streaming.incremental import IncrementalMetrics
from verdant.streaming.pipelines import scratch


def _prices(seed, symbols=4, days=320):
    rnd = random.Random(seed)
    out = {}
    for s in range(symbols):
        close = 100.0
        for k in sorted(rnd.sample(range(900), days if s else 61)):
            close = max(0.01, close * (1 + rnd.choice([0, 0.01, -0.02, 0.03, -0.015])))
            out[(f"S{s}", dt.date(2020, 1, 1) + dt.timedelta(days=k))] = close
    return out


def _rows(prices):
    return [(s, d, c) for (s, d), c in prices.items()]


def _near(a, b):
    return a == b if a is None or b is None or not isinstance(a, float) else abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))


def _same(got, want):
    got, want = ({r.symbol: r.asDict() for r in x.collect()} for x in (got, want))
    assert set(got) == set(want)
    for s in want:
        for c, v in want[s].items():
            assert _near(got[s][c], v), (s, c, got[s][c], v)


@pytest.fixture(scope="module")
def dims(spark):
    esg = spark.createDataFrame([("S0", 40.0, 1.0, 2.0, 3.0), ("S1", 60.0, 1.0, 2.0, 3.0), ("S1", 70.0, 4.0, 2.0, 3.0), ("S3", 10.0, 1.0, 1.0, 1.0)],
                                "symbol string, composite_score double, e_score double, s_score double, g_score double")
    companies = spark.createDataFrame([("S0", "A", False, False), ("S1", "A", False, False), ("S2", "B", True, False), ("S3", None, False, False)],
                                      "symbol string, sector string, restricted_business boolean, severe_controversy boolean")
    return esg, companies


@pytest.mark.parametrize("cuts", [1, 2, 7, 61, 320])
def test_states_of_any_cut_fold_to_the_whole(spark, cuts):
    p = spark.createDataFrame(_rows(_prices(cuts)), "symbol string, date date, close double")
    piece = F.floor(F.datediff("date", F.lit("2020-01-01").cast("date")) * cuts / 900).cast("int")
    states = G.segment_states(p.withColumn("piece", piece), ["symbol", "piece"])
    whole = states.groupBy("symbol").agg(G.fold(F.transform(
        F.array_sort(F.collect_list(F.struct("piece", "state"))), lambda x: x["state"])).alias("state"))
    got = whole.select("symbol", *[c.alias(k) for k, c in G.metric_columns(F.col("state"), M.MIN_RETURNS).items()])
    _same(got, M.symbol_metrics(p).select(*got.columns))


def test_flat_short_and_single_histories(spark):
    day = lambda k: dt.date(2021, 12, 20) + dt.timedelta(days=k)
    rows = [("flat", day(k), 5.0) for k in range(40)] + [("one", day(0), 7.0)] + [("loss", day(k), 9.0 + (k != 30)) for k in range(30)]
    rows += [("nulls", day(k), None if k % 2 else 3.0 + k) for k in range(60)] + [("zero", day(k), float(k % 4)) for k in range(50)]
    p = spark.createDataFrame(rows, "symbol string, date date, close double")
    states = G.segment_states(p.withColumn("year", F.year("date")), ["symbol", "year"])
    whole = states.groupBy("symbol").agg(G.fold(F.transform(
        F.array_sort(F.collect_list(F.struct("year", "state"))), lambda x: x["state"])).alias("state"))
    got = whole.select("symbol", *[c.alias(k) for k, c in G.metric_columns(F.col("state"), 1).items()])
    want = M.symbol_metrics(p).select(*got.columns)
    enough = F.col("n_returns") >= M.MIN_RETURNS
    _same(got.where(enough), want.where(enough))


def test_random_batches_with_late_and_restated_dates(spark, dims):
    esg, companies = dims
    rnd = random.Random(11)
    truth, log = {}, []
    for (s, d), c in _prices(3, days=150).items():
        truth[(s, d)] = c
        log.append((rnd.randrange(3), s, d, c))
        if rnd.random() < 0.2:                                    # restated in a later batch
            truth[(s, d)] = c * rnd.choice([0.9, 1.05])
            log.append((3, s, d, truth[(s, d)]))
    log += [(2, None, dt.date(2020, 5, 5), 1.0), (2, "S1", None, 1.0), (2, "S1", dt.date(2020, 5, 5), None), (1, "S9", dt.date(2020, 5, 5), 4.0)]
    tables = IncrementalMetrics(spark, scratch(spark, "t-k4"), esg, companies)
    for k in range(4):
        rows = [r[1:] for r in log if r[0] == k]
        for _ in range(2 if k == 2 else 1):                       # one batch is replayed
            tables.apply(spark.createDataFrame(rows, "symbol string, date date, close double"), k)
    whole = spark.createDataFrame(_rows(truth), "symbol string, date date, close double")
    full = M.recompute(whole, esg, companies)
    _same(tables.current_metrics(), full)
    got = sorted(map(tuple, tables.current_sectors().select("sector", "company_count").collect()))
    assert got == sorted(map(tuple, M.sector_rankings(full, companies).select("sector", "company_count").collect()))


def test_a_batch_reads_only_what_it_restates(spark, dims):
    esg, companies = dims
    root = scratch(spark, "t-k4r")
    tables = IncrementalMetrics(spark, root, esg, companies)
    p = spark.createDataFrame(_rows(_prices(8)), "symbol string, date date, close double").persist()
    tables.apply(p, 0)
    before = {name: set(t._newest(None).items()) for name, t in (("states", tables.states), ("metrics", tables.metrics))}
    broken = f"{root}/prices/batch_id=0/year=2021"                # an untouched year's rows are out of reach
    fs, path = tables.states._fs, tables.states._path
    fs.delete(path(broken), True)
    tables.apply(spark.createDataFrame([("S2", dt.date(2020, 1, 2), 50.0)], "symbol string, date date, close double"), 1)
    changed = p.where("not (symbol = 'S2' and date = '2020-01-02')").unionByName(
        spark.createDataFrame([("S2", dt.date(2020, 1, 2), 50.0)], p.schema))
    _same(tables.current_metrics(), M.recompute(changed, esg, companies, as_of=F.lit(tables._newest_date())))
    after = {"states": set(tables.states._newest(None).items()), "metrics": set(tables.metrics._newest(None).items())}
    assert len(after["states"] - before["states"]) == 1           # one bucket, one sector
    assert {p for p, _ in after["metrics"] - before["metrics"]} == {"s" + "B".encode().hex()}
    p.unpersist()
