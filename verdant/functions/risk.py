"""Per-key risk measures over an ordered price or return series.

``return_path`` (E1) is the one windowed pass: it adds the simple return, the
row position, the series length and two running peaks. Everything else here is
an aggregate Column builder (E2–E9) meant for one ``groupBy(key).agg(...)`` over
that output, so a whole table of symbols (or portfolios) is measured with one
shuffle by key and one sort.

Conventions (fixed values of the measures):
  * annualisation factor 252 trading days, sample standard deviation;
  * Sharpe / Sortino are 0 when their deviation is 0; Sortino is 0 with no
    losing day and NULL with exactly one (its deviation is undefined);
  * Calmar is 0 when the drawdown is 0; annual return is 0 when the series is
    empty or the total return is at or below -100 %;
  * momentum(k) is 0 with fewer than k+1 prices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252
SQRT_TRADING_DAYS = math.sqrt(TRADING_DAYS)

# Column names added by return_path.
RN, N, RET, PEAK, PEAK_EX_FIRST = "_rn", "_n", "ret", "_peak", "_peak2"


def return_path(df: DataFrame, key: str = "symbol", order: str = "date",
                price: str = "close") -> DataFrame:
    """Simple returns p_t / p_{t-1} - 1 per key, plus position, length and
    running peaks (over all prices, and over prices from the second on).

    NULL prices are dropped first; the first row of each key has a NULL return.
    All window columns share one partitioning and one ordering, so the plan has
    a single exchange and a single sort.
    """
    w = Window.partitionBy(key).orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = df.where(F.col(price).isNotNull())
    p = p.select(
        key, order, price,
        F.row_number().over(w).alias(RN),
        F.count(F.lit(1)).over(whole).alias(N),
        (F.try_divide(F.col(price), F.lag(price).over(w)) - 1).alias(RET),
        F.max(price).over(running).alias(PEAK),
    )
    return p.withColumn(
        PEAK_EX_FIRST, F.max(F.when(F.col(RN) >= 2, F.col(price))).over(running))


def _excess(ret: str, rf: float) -> Column:
    return F.col(ret) - F.lit(rf / TRADING_DAYS)


def sharpe(ret: str = RET, rf: float = 0.0) -> Column:
    """mean(excess) / std(excess) * sqrt(252); 0 when std is 0."""
    ex = _excess(ret, rf)
    sd = F.stddev_samp(ex)
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(F.avg(ex), sd) * SQRT_TRADING_DAYS)


def sortino(ret: str = RET, rf: float = 0.0) -> Column:
    """mean(excess) / std(negative excess) * sqrt(252)."""
    ex = _excess(ret, rf)
    down = F.when(ex < 0, ex)
    dsd = F.stddev_samp(down)
    return (F.when(F.count(down) == 0, F.lit(0.0))
             .when(dsd == 0, F.lit(0.0))
             .otherwise(F.try_divide(F.avg(ex), dsd) * SQRT_TRADING_DAYS))


def max_drawdown(price: str = "close", peak: str = PEAK) -> Column:
    """E5: min((p - running max) / running max); 0 when empty."""
    return F.coalesce(F.min(F.try_divide(F.col(price) - F.col(peak), F.col(peak))), F.lit(0.0))


def max_drawdown_returns(price: str = "close", peak: str = PEAK_EX_FIRST) -> Column:
    """Drawdown of the compounded return curve, whose first point is
    1 + r_1 — the price drawdown over prices from the second one on."""
    return max_drawdown(price, peak)


def annual_return_from_prices(price: str = "close", rn: str = RN, n: str = N) -> Column:
    """E7 for a price series: the product of (1 + r) telescopes to
    last / first; (last/first)^(252/returns) - 1."""
    first = F.max(F.when(F.col(rn) == 1, F.col(price)))
    last = F.max(F.when(F.col(rn) == F.col(n), F.col(price)))
    n_ret = F.count(F.lit(1)) - 1
    total = F.try_divide(last, first) - 1
    return (F.when(n_ret <= 0, F.lit(0.0))
             .when(total <= -1, F.lit(0.0))
             .otherwise(F.pow(1 + total, F.try_divide(F.lit(float(TRADING_DAYS)), n_ret)) - 1))


def annual_return(ret: str = RET) -> Column:
    """E7 for a return series: (prod(1 + r))^(252/n) - 1."""
    n_ret = F.count(ret)
    total = F.product(1 + F.col(ret)) - 1
    return (F.when(n_ret == 0, F.lit(0.0))
             .when(total <= -1, F.lit(0.0))
             .otherwise(F.pow(1 + total, F.try_divide(F.lit(float(TRADING_DAYS)), n_ret)) - 1))


def annual_volatility(ret: str = RET) -> Column:
    """std(r) * sqrt(252); 0 for an empty series."""
    return F.when(F.count(ret) == 0, F.lit(0.0)).otherwise(F.stddev_samp(ret) * SQRT_TRADING_DAYS)


def calmar(annual: Column, mdd: Column) -> Column:
    """Annual return / |max drawdown of the return curve|; 0 when the
    drawdown is 0."""
    return F.when(mdd == 0, F.lit(0.0)).otherwise(F.try_divide(annual, F.abs(mdd)))


def momentum(k: int, price: str = "close", rn: str = RN, n: str = N) -> Column:
    """Last price vs the price k rows earlier; 0 with fewer than k+1."""
    last = F.max(F.when(F.col(rn) == F.col(n), F.col(price)))
    back = F.max(F.when(F.col(rn) == F.col(n) - k, F.col(price)))
    return (F.when(F.count(F.lit(1)) < k + 1, F.lit(0.0))
             .otherwise(F.try_divide(last - back, back)))
