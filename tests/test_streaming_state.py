"""The state of the differential-Sharpe stream is kept by buckets of portfolios."""

import datetime as dt
import time

from verdant.operators import backtest as B
from verdant.streaming import pipelines as K

SCHEMA = "portfolio_id bigint, date date, port_return double"


def _streamed(spark, batches, **kw):
    """What the stream gives over one file a batch, and its last progress."""
    root = K.scratch(spark, "t-k3")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/src/p{k}")
        time.sleep(0.2)                                      # files are taken by their time
    q = K.differential_sharpe_stream(spark, f"{root}/src/*", f"{root}/sink", f"{root}/ckpt", **kw)
    q.awaitTermination()
    assert q.exception() is None, q.exception()
    return spark.read.parquet(f"{root}/sink"), q.lastProgress


def _day(n):
    return dt.date(2001, 1, 1) + dt.timedelta(days=n)


def test_many_portfolios_share_an_entry_of_the_state_store(spark):
    ids = [None, 0, -7, 2 ** 53 + 1, 2 ** 53 + 2, *range(1, 300)]
    rows = [(i, _day(d), ((n * 31 + d * 17) % 41 - 20) / 1000) for n, i in enumerate(ids) for d in range(n % 3, 9, 1 + n % 2)]
    batches = [[r for r in rows if lo <= (r[1] - _day(0)).days < lo + 3] for lo in (0, 3, 6)]
    out, progress = _streamed(spark, batches, buckets=8)
    assert progress["stateOperators"][0]["numRowsTotal"] <= 8
    batch = B.differential_sharpe(spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA))
    got = {(r.portfolio_id, r.date): r.dsr for r in out.collect()}
    assert len(got) == len(rows) == out.where("not late").count()
    assert all(abs(got[r.portfolio_id, r.date] - r.dsr) < 1e-9 for r in batch.collect())


def test_late_rows_and_time_to_live_are_a_portfolios_own(spark):
    batches = [[(1, _day(0), 0.01), (2, _day(0), 0.02), (3, _day(0), 0.01)],
               [(2, _day(30), 0.03), (1, _day(0), 0.5), (3, _day(28), 0.02)],     # 1: the same day again is late
               [(2, _day(40), 0.01)],                                             # 1 is beyond its time now, 3 is not
               [(1, _day(41), 0.04), (3, _day(42), 0.01)]]
    out, _ = _streamed(spark, batches, ttl_days=20, buckets=1)
    rows = {(r.portfolio_id, (r.date - _day(0)).days, r.late): r.dsr for r in out.collect()}
    # 0.5 lies on the watermark of its batch or is marked late: it is never a step
    assert [k for k in rows if k[:2] == (1, 0) and not k[2]] == [(1, 0, False)]
    a0, b0 = B.DSR_A0, B.DSR_B0
    assert rows[1, 41, False] == B.dsr_step(a0, b0, 0.04, B.DSR_ETA)[2]           # starts anew
    for p, steps in {2: [(0, 0.02), (30, 0.03), (40, 0.01)], 3: [(0, 0.01), (28, 0.02), (42, 0.01)]}.items():
        a, b = a0, b0
        for d, r in steps:
            a, b, value = B.dsr_step(a, b, r, B.DSR_ETA)
            assert rows[p, d, False] == value
