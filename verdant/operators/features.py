"""Rolling features and the feature panel.

All rolling values share ``Window.partitionBy("symbol").orderBy("date")``: one
exchange by symbol and one sort serve F1–F4 and F7. The two recurrences (EMA
and MACD, F5/F6) have no window form; they run in one sorted Arrow pass per
partition (``run_by_key``), each kernel call seeing one symbol's daily history
— bounded by the number of trading dates, not by the table size.

A panel lies on each symbol's own dates, or on one calendar for all, where a
symbol may have gaps: returns and momentum then look at the last known close,
rolling values need every close of their window, and EMAs decay over the gap
(``functions.scan``).

A rolling value is NULL until its window is full (pandas ``min_periods`` equal
to the window). RSI and %B are filled with their neutral values (50 and 0.5)
wherever undefined, as in the reference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.functions.scan import macd_at_closes
from verdant.functions.sequential import run_by_key
from verdant.operators.query import latest
from verdant.sources.tables import by_symbol

# Fixed values of the feature definitions.
RSI_PERIOD = 14
BOLLINGER_PERIOD = 20
VOL_PERIOD = 20
DRAWDOWN_PERIOD = 60
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
ESG_DEFAULT = 0.5
FEATURES = ["f0_return", "f1_mom20", "f2_mom60", "f3_vol20", "f4_dd60", "f5_esg1",
            "f6_esg2", "f7_macd", "f8_rsi", "f9_pct_b", "f10_volume_change"]


def _w(key: str = "symbol", order: str = "date") -> Window:
    return Window.partitionBy(key).orderBy(order)


def _rolling(n: int, key: str = "symbol", order: str = "date") -> Window:
    return _w(key, order).rowsBetween(-(n - 1), 0)


def momentum_col(k: int, price: str = "close", key: str = "symbol") -> Column:
    """p / p_{-k} − 1 (NULL for the first k rows)."""
    return F.try_divide(F.col(price), F.lag(price, k).over(_w(key))) - 1


def return_col(price: str = "close", key: str = "symbol") -> Column:
    return momentum_col(1, price, key)


def rolling_vol(ret: str = "f0_return", n: int = VOL_PERIOD, key: str = "symbol") -> Column:
    """sample std of the last n returns, NULL until n returns exist."""
    w = _rolling(n, key)
    return F.when(F.count(ret).over(w) >= n, F.stddev_samp(ret).over(w))


def rolling_drawdown(price: str = "close", n: int = DRAWDOWN_PERIOD, key: str = "symbol", frame: Window | None = None) -> Column:
    """p / max(last n prices) − 1, NULL until n prices exist (in ``frame``, by default the last n rows)."""
    w = frame or _rolling(n, key)
    return F.when(F.count(price).over(w) >= n, F.try_divide(F.col(price), F.max(price).over(w)) - 1)


def rsi(price: str = "close", n: int = RSI_PERIOD, key: str = "symbol") -> Column:
    """RSI from simple means of gains and losses over n rows. The first
    row counts as zero gain and zero loss; 50 wherever undefined, including
    when the mean loss is 0 (not 100)."""
    delta = F.col(price) - F.lag(price).over(_w(key))
    gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
    loss = -F.when(delta < 0, delta).otherwise(F.lit(0.0))
    w = _rolling(n, key)
    full = F.count(F.lit(1)).over(w) >= n
    avg_gain = F.when(full, F.avg(gain).over(w))
    avg_loss = F.when(full, F.avg(loss).over(w))
    rs = F.try_divide(avg_gain, F.nullif(avg_loss, F.lit(0.0)))
    return F.coalesce(100 - 100 / (1 + rs), F.lit(50.0))


def bollinger_pct_b(price: str = "close", n: int = BOLLINGER_PERIOD, key: str = "symbol", frame: Window | None = None) -> Column:
    """%B = (p − lower) / (upper − lower), bands sma ± 2·sample std over
    n rows (or ``frame``); 0.5 wherever undefined."""
    w = frame or _rolling(n, key)
    full = F.count(price).over(w) >= n
    sma = F.when(full, F.avg(price).over(w))
    sd = F.when(full, F.stddev_samp(price).over(w))
    upper = sma + 2 * sd
    lower = sma - 2 * sd
    width = upper - lower
    return F.coalesce(F.try_divide(F.col(price) - lower, F.nullif(width, F.lit(0.0))), F.lit(0.5))


# ------------------------------------------------------------ F5 / F6 (Arrow)

def _ema(x: np.ndarray, span: int) -> np.ndarray:
    """y0 = x0, y_t = α·x_t + (1 − α)·y_{t−1}, α = 2/(span+1)."""
    a = 2.0 / (span + 1.0)
    out = np.empty_like(x)
    y = x[0]
    out[0] = y
    for i in range(1, len(x)):
        y = a * x[i] + (1.0 - a) * y
        out[i] = y
    return out


def ema_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """EMA / MACD columns for one symbol's rows, sorted by date."""
    spans = (MACD_FAST, MACD_SLOW)
    x = pdf["close"].to_numpy(dtype="float64")
    out = pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "date": pdf["date"].to_numpy()})
    if len(x) == 0:
        return out.assign(ema_fast=[], ema_slow=[], macd=[], macd_signal=[], macd_hist=[])
    fast, slow = _ema(x, spans[0]), _ema(x, spans[1])
    line = fast - slow
    signal = _ema(line, MACD_SIGNAL)
    out["ema_fast"] = fast
    out["ema_slow"] = slow
    out["macd"] = line
    out["macd_signal"] = signal
    out["macd_hist"] = line - signal
    return out


EMA_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("ema_fast", T.DoubleType()), T.StructField("ema_slow", T.DoubleType()),
    T.StructField("macd", T.DoubleType()), T.StructField("macd_signal", T.DoubleType()),
    T.StructField("macd_hist", T.DoubleType()),
])


def ema_macd(prices: DataFrame) -> DataFrame:
    """F5 + F6: EMA12, EMA26, MACD line, signal (EMA9 of the line) and
    histogram for every symbol and date, in one grouped Arrow pass."""
    p = prices.where(F.col("close").isNotNull()).select("symbol", "date", "close")
    return run_by_key(p, "symbol", "date", ema_frame, EMA_SCHEMA)


# -------------------------------------------------------------- D5, D6, F8

def esg_unit_score(esg: DataFrame) -> DataFrame:
    """Mean composite / 100 per symbol (default applied by the caller's
    left join: ESG_DEFAULT)."""
    return esg.groupBy("symbol").agg((F.avg("composite_score") / 100).alias("esg_unit"))


def with_esg(panel: DataFrame, esg: DataFrame) -> DataFrame:
    """F8: two static ESG unit columns repeated on every date, 0.5 default."""
    u = esg_unit_score(esg)
    j = panel.join(u, "symbol", "left")
    unit = F.coalesce(F.col("esg_unit"), F.lit(ESG_DEFAULT))
    return j.withColumn("f5_esg1", unit).withColumn("f6_esg2", unit).drop("esg_unit")


def cross_section(panel: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Per date the mean, sample std and max of each feature over assets."""
    feats = features or FEATURES
    aggs = []
    for f in feats:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std"),
                 F.max(f).alias(f"{f}_max")]
    return panel.groupBy("date").agg(*aggs)


# ------------------------------------------------------------------ F9–F13

def _calendar_closes(prices: DataFrame) -> tuple[DataFrame, Column]:
    """The closes by symbol and position on the calendar of all dates that have
    a close at all (a close without date: -1), and the calendar, one array."""
    p = prices.where(F.col("close").isNotNull()).groupBy("symbol", "date").agg(F.max("close").alias("close"))
    days = p.where(F.col("date").isNotNull()).select("date").distinct()
    places = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))
    placed = p.join(F.broadcast(places), "date", "left")                 # as many rows as trading dates
    return (placed.select("symbol", F.coalesce("pos", F.lit(-1)).alias("pos"), "close"),
            days.agg(F.array_sort(F.collect_list("date"))).scalar())


def _over_gaps(closes: DataFrame, calendar: Column) -> DataFrame:
    """A row for every date of every symbol from its rows in ``closes`` (symbol,
    pos, close, …): each stands for its own date and the gap up to the next
    (the first one also for the dates before), where ``at`` is the position and
    ``known`` the last close up to then. No row leaves its symbol's task."""
    w = _w(order="pos")
    before, after = F.lag("pos").over(w), F.lead("pos").over(w)
    first = F.col("pos").eqNullSafe(F.lit(-1)) | (before.isNotNull() & (before >= 0))
    rows = closes.select(
        "*", F.when(first, F.col("pos")).otherwise(0).alias("_from"),
        F.when((F.col("pos") == -1) & after.isNotNull(), -1).otherwise(F.coalesce(after - 1, F.size(calendar) - 1)).alias("_to"),
        F.when(before == -1, F.lag("close").over(w)).alias("_undated"))
    rows = rows.select("*", F.explode(F.sequence("_from", "_to")).alias("at"))
    return rows.select(
        "*", F.when(F.col("at") >= 0, F.element_at(calendar, F.col("at") + 1)).alias("date"),
        F.when(F.col("at") >= F.col("pos"), F.col("close")).otherwise(F.col("_undated")).alias("known"))


def common_calendar(prices: DataFrame) -> DataFrame:
    """Every symbol on every date of the table that has a close at all:
    symbol, date, pos (0, 1, … over the calendar), close (NULL in a gap) and
    ``known``, the last close up to then."""
    rows = _over_gaps(*_calendar_closes(prices))
    return rows.select("symbol", "date", F.when(F.col("at") >= 0, F.col("at")).alias("pos"),
                       F.when(F.col("at") == F.col("pos"), F.col("close")).alias("close"), "known")


def _common_features(prices: DataFrame, with_macd: bool, n_rows: int | None) -> DataFrame:
    """The price features on the common calendar. What needs every close of its
    window (drawdown, %B) and the MACD histogram is worked out on the closes
    alone, before the gaps are filled: in a gap the former have no value, and
    the histogram shrinks by the signal's share a date."""
    closes, calendar = _calendar_closes(prices)
    if with_macd:
        closes = macd_at_closes(closes, "symbol", (MACD_FAST, MACD_SLOW, MACD_SIGNAL))
        closes = by_symbol(closes, n_rows) if n_rows else closes
    else:
        closes = closes.withColumn("macd_hist", F.lit(None).cast("double"))
    dates = lambda n: _w(order="pos").rangeBetween(-(n - 1), 0)
    closes = closes.select("*", rolling_drawdown(frame=dates(DRAWDOWN_PERIOD)).alias("_dd"),
                           bollinger_pct_b(frame=dates(BOLLINGER_PERIOD)).alias("_pct_b"))
    here = F.col("at") == F.col("pos")
    faded = F.pow(F.lit(1.0 - 2.0 / (MACD_SIGNAL + 1.0)), F.col("at") - F.col("pos"))
    rows = _over_gaps(closes, calendar).select(
        "symbol", "date", F.when(here, F.col("close")).alias("close"), "known",
        F.when(here, F.col("_dd")).alias("f4_dd60"), F.when(here, F.col("_pct_b")).otherwise(0.5).alias("f9_pct_b"),
        F.when(F.col("symbol").isNotNull() & (F.col("at") >= F.col("pos")), F.col("macd_hist") * faded).alias("f7_macd"))
    return rows.select(
        "symbol", "date", "close", return_col("known").alias("f0_return"), momentum_col(20, "known").alias("f1_mom20"),
        momentum_col(60, "known").alias("f2_mom60"), "f4_dd60", (rsi() / 100.0).alias("f8_rsi"), "f9_pct_b", "f7_macd")


def feature_panel(prices: DataFrame, esg: DataFrame, with_macd: bool = True, calendar: str = "own",
                  n_rows: int | None = None) -> DataFrame:
    """(symbol, date, close, f0…f10) on each symbol's own trading dates
    (``calendar="own"``) or on the common calendar of all (``"common"``), with
    NULL closes in the gaps.

    f0 return, f1/f2 momentum 20/60, f3 20-day volatility, f4 60-day
    drawdown, f5/f6 ESG unit score, f7 MACD histogram, f8 RSI/100, f9 %B,
    f10 volume change (always 0, as in the reference). ``n_rows``, where known,
    is the number of rows the prices come from: the common panel is dealt over
    as many partitions as they need."""
    if calendar not in ("own", "common"):
        raise ValueError("the calendar is 'own' or 'common'")
    if calendar == "common":
        p = _common_features(prices, with_macd, n_rows)
    else:
        p = prices.where(F.col("close").isNotNull()).select("symbol", "date", "close").select(
            "symbol", "date", "close",
            return_col("close").alias("f0_return"),
            momentum_col(20).alias("f1_mom20"),
            momentum_col(60).alias("f2_mom60"),
            rolling_drawdown().alias("f4_dd60"),
            (rsi() / 100.0).alias("f8_rsi"),
            bollinger_pct_b().alias("f9_pct_b"),
        )
    p = p.withColumn("f3_vol20", rolling_vol("f0_return"))
    p = with_esg(p, esg)
    if calendar == "own" and with_macd:
        m = ema_macd(prices).select("symbol", "date", F.col("macd_hist").alias("f7_macd"))
        p = p.join(m, ["symbol", "date"], "left")
    elif calendar == "own":
        p = p.withColumn("f7_macd", F.lit(None).cast("double"))
    p = p.withColumn("f10_volume_change", F.lit(0.0))
    return p.select("symbol", "date", "close", *FEATURES)


def trim_warmup(panel: DataFrame, features: list[str] | None = None) -> DataFrame:
    """drop dates before the first date on which every asset has every
    feature; later NULLs become 0. If no date is complete, nothing is dropped
    (the reference keeps the whole span)."""
    feats = features or FEATURES
    complete = F.lit(True)
    for f in feats:
        complete = complete & F.col(f).isNotNull()
    n_assets = panel.select(F.countDistinct("symbol")).scalar()
    per_date = panel.groupBy("date").agg(F.count_if(complete).alias("_complete"))
    first_ok = per_date.where(F.col("_complete") == n_assets).select(F.min("date")).scalar()
    start = F.coalesce(first_ok, panel.select(F.min("date")).scalar())
    return panel.where(F.col("date") >= start).fillna(0.0, subset=feats)


def coverage(prices: DataFrame, min_share: float = 0.95) -> DataFrame:
    """symbols with a non-NULL close on at least int(min_share · T)
    distinct dates, T = distinct dates of the table."""
    t = prices.select(F.countDistinct("date")).scalar()
    need = F.floor(t * F.lit(min_share))
    per = prices.groupBy("symbol").agg(F.count("close").alias("n_dates"))
    return per.where(F.col("n_dates") >= need)


def pivot_prices(prices: DataFrame, symbols: list[str]) -> DataFrame:
    """Wide date × symbol export of closes (symbols listed explicitly so the
    pivot needs no extra pass)."""
    return prices.groupBy("date").pivot("symbol", symbols).agg(F.first("close"))


def sector_index(companies: DataFrame) -> DataFrame:
    """integer per sector — dense rank over the distinct sector names
    (1…k); NULL sector is its own group, 0."""
    s = companies.select("sector").distinct()
    idx = (s.where(F.col("sector").isNotNull())
            .select(F.col("sector").alias("_sector"),
                    F.dense_rank().over(Window.orderBy("sector")).alias("sector_id")))
    j = companies.join(idx, F.col("sector").eqNullSafe(F.col("_sector")), "left")
    return j.select(*companies.columns, F.coalesce(F.col("sector_id"), F.lit(0)).alias("sector_id"))


def time_split(panel: DataFrame, train_share: float = 0.7) -> DataFrame:
    """first int(train_share · T) distinct dates are 'train', the rest
    'test'. Dates are ranked on the distinct-date table (the calendar, small)."""
    cal = panel.select("date").distinct()
    cal = cal.withColumn("_pos", F.row_number().over(Window.orderBy("date")))
    t = cal.select(F.count(F.lit(1))).scalar()
    cal = cal.withColumn("split", F.when(F.col("_pos") <= F.floor(t * F.lit(train_share)),
                                         F.lit("train")).otherwise(F.lit("test")))
    return panel.join(cal.select("date", "split"), "date")


def latest_esg(esg: DataFrame) -> DataFrame:
    """Newest ESG row per (symbol, provider)."""
    return latest(esg, ["symbol", "provider"], "date")
