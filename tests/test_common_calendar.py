"""Common-calendar features against pandas, with gaps, late listings and small scan blocks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdant.functions import scan
from verdant.operators import features as FE


def _wide(seed, dates=150):
    rnd = random.Random(seed)
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=k) for k in range(dates)]
    out = pd.DataFrame(index=days)
    for s, (start, miss) in {"FULL": (0, 0), "GAPS": (0, 0.2), "LATE": (70, 0.05), "RARE": (10, 0.9), "FLAT": (0, 0)}.items():
        close, col = 50.0, []
        for k in range(dates):
            close = close if s == "FLAT" else close * (1 + rnd.uniform(-0.03, 0.03))
            col.append(close if k >= start and rnd.random() >= miss else np.nan)
        out[s] = col
    return out


def _expected(p):
    known = p.ffill()
    delta = p.diff()
    gain, loss = delta.where(delta > 0, 0.0).rolling(14).mean(), (-delta.where(delta < 0, 0.0)).rolling(14).mean()
    line = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
    sma, sd = p.rolling(20).mean(), p.rolling(20).std()
    ret = known.pct_change(fill_method=None)
    return {"f0_return": ret, "f1_mom20": known.pct_change(20, fill_method=None), "f2_mom60": known.pct_change(60, fill_method=None),
            "f3_vol20": ret.rolling(20).std(), "f4_dd60": p / p.rolling(60).max() - 1,
            "f7_macd": line - line.ewm(span=9, adjust=False).mean(),
            "f8_rsi": (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(50.0) / 100,
            "f9_pct_b": ((p - (sma - 2 * sd)) / (4 * sd).replace(0, np.nan)).fillna(0.5)}


def _long(spark, wide):
    rows = [(s, d, float(c)) for s in wide for d, c in wide[s].items() if c == c]
    return spark.createDataFrame(rows, "symbol string, date date, close double").repartition(3)


@pytest.fixture(scope="module")
def esg(spark):
    return spark.createDataFrame([("FULL", 40.0)], "symbol string, composite_score double")


def test_panel_equals_pandas(spark, esg):
    wide = _wide(1)
    prices = _long(spark, wide).unionByName(spark.createDataFrame([("GAPS", dt.date(2030, 1, 1), None)], "symbol string, date date, close double"))
    rows = FE.feature_panel(prices, esg, calendar="common").toPandas()
    assert len(rows) == wide.size
    for name, want in _expected(wide).items():
        got = rows.pivot(index="date", columns="symbol", values=name).loc[wide.index, wide.columns].astype(float)
        if name == "f9_pct_b":                       # a flat window has a deviation of zero, or of rounding
            got, want = got.drop(columns="FLAT"), want.drop(columns="FLAT")
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12, equal_nan=True), name
    assert set(rows[rows.symbol == "FULL"].f5_esg1) == {0.4} and set(rows[rows.symbol == "RARE"].f5_esg1) == {0.5}
    with pytest.raises(ValueError):
        FE.feature_panel(prices, esg, calendar="lunar")


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_scan_is_the_same_however_the_calendar_is_cut(spark, block):
    wide = _wide(2, dates=130)
    wide.loc[wide.index[5:40], "GAPS"] = np.nan              # a gap over whole blocks
    grid = FE.common_calendar(_long(spark, wide))
    rows = scan.gap_aware_macd(grid, block=block).toPandas()
    assert len(rows) == wide.size
    fast, slow = (wide.ewm(span=k, adjust=False).mean() for k in (12, 26))
    for name, want in {"ema_fast": fast, "ema_slow": slow, "macd_signal": (fast - slow).ewm(span=9, adjust=False).mean()}.items():
        got = rows.pivot(index="date", columns="symbol", values=name).loc[wide.index, wide.columns].astype(float)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12, equal_nan=True), name


def test_trim_drops_the_dates_before_all_features(spark, esg):
    wide = _wide(3)[["FULL", "LATE", "FLAT"]]
    late = wide["LATE"].copy()
    wide["LATE"] = wide["FULL"].where([k >= 30 for k in range(len(late))])        # listed on date 30, no gaps
    panel = FE.feature_panel(_long(spark, wide), esg, calendar="common")
    trimmed = FE.trim_warmup(panel)
    first = trimmed.select(F.min("date")).first()[0]
    assert first == wide.index[90]                           # 60 dates after the last listing
    assert trimmed.count() == 3 * (len(wide) - 90)
    never = FE.trim_warmup(FE.feature_panel(_long(spark, _wide(4)), esg, calendar="common"))
    assert never.select(F.min("date")).first()[0] == _wide(4).index[0] and never.where("f4_dd60 is null").count() == 0


def test_pivot_exports_closes(spark):
    wide = _wide(5, dates=12)
    out = FE.pivot_prices(_long(spark, wide), ["FULL", "RARE"]).orderBy("date").toPandas().set_index("date")
    got = out.reindex(wide.index)[["FULL", "RARE"]].astype(float)
    assert np.allclose(got, wide[["FULL", "RARE"]], equal_nan=True)


def test_macd_walks_the_closes_alone(spark):
    """a row per close goes through the pass, none per date; batches may cut a key."""
    wide = _wide(6)
    closes, calendar = FE._calendar_closes(_long(spark, wide))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = scan.macd_at_closes(closes).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(rows) == int(wide.notna().sum().sum())
    fast, slow = (wide.ewm(span=k, adjust=False).mean() for k in (12, 26))
    want = (fast - slow) - (fast - slow).ewm(span=9, adjust=False).mean()
    for r in rows.itertuples():
        assert np.isclose(r.macd_hist, want[r.symbol].iloc[r.pos], rtol=1e-9, atol=1e-12)


def test_closes_without_date_or_symbol(spark, esg):
    d = [dt.date(2024, 1, k) for k in (1, 2, 3)]
    rows = [("A", None, 5.0), ("A", d[1], 10.0), ("B", None, 7.0), ("B", None, 6.0), (None, d[0], 1.0), (None, d[2], 2.0), ("A", d[1], 4.0)]
    p = FE.common_calendar(spark.createDataFrame(rows, "symbol string, date date, close double"))
    got = {(r.symbol, r.date): (r.pos, r.close, r.known) for r in p.collect()}
    assert got == {("A", None): (None, 5.0, 5.0), ("A", d[0]): (0, None, 5.0), ("A", d[1]): (1, 10.0, 10.0), ("A", d[2]): (2, None, 10.0),
                   ("B", None): (None, 7.0, 7.0), ("B", d[0]): (0, None, 7.0), ("B", d[1]): (1, None, 7.0), ("B", d[2]): (2, None, 7.0),
                   (None, d[0]): (0, 1.0, 1.0), (None, d[1]): (1, None, 1.0), (None, d[2]): (2, 2.0, 2.0)}
