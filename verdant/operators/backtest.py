"""Back-tests over many portfolios at once.

Weights decided on a date are applied to the return of the next trading date
(C7). The next date comes from a table of the days between trading dates, and the weight × return product
is an equi-join on (symbol, next date). Running values (equity, peak, rolling
volatility) are windows per portfolio ordered by date; the two recurrences with
no window form (differential Sharpe, discounted return-to-go) run in one sorted
pass per partition (``run_values``), each kernel call seeing one portfolio's
date history.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.functions import risk
from verdant.functions.sequential import run_values
from verdant.sources.tables import dealt

# Fixed values of the back-test and reward rules.
ROLLING_VOL_ROWS = 20
ALPHA_RISK, BETA_TURNOVER, GAMMA_DRAWDOWN, DRAWDOWN_THRESHOLD = 0.05, 0.001, 0.1, 0.1
DSR_ETA, DSR_A0, DSR_B0, DSR_EPS = 0.01, 0.0, 1e-8, 1e-12
DISCOUNT = 0.99
RTG_EPS = 1e-8
HOLDING_MIN_WEIGHT = 0.01


def _next_trading_date(rows: DataFrame, returns: DataFrame, date: str = "date") -> DataFrame:
    """``rows`` with next_date, the first trading date after their date, whether
    or not it is one itself; NULL after the last. Each trading date but the
    first stands for the days since the one before it: as many rows as days,
    and ``rows`` are worked out once."""
    traded = returns.where(F.col("date").isNotNull()).select("date").distinct()
    before = F.coalesce(F.lag("date").over(Window.orderBy("date")), F.date_sub("date", 1))
    days = traded.select(F.col("date").alias("next_date"), before.alias("_from")).select(
        "next_date", F.explode(F.sequence("_from", F.date_sub("next_date", 1))).alias("_day"))
    first = traded.select(F.min("date")).scalar()
    j = rows.join(F.broadcast(days), F.col(date) == F.col("_day"), "left").drop("_day")
    return j.withColumn("next_date", F.coalesce("next_date", F.when(F.col(date) < first, first)))


def weights_to_next_return(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Each (portfolio, date, symbol, weight) row with the symbol's return
    on the next trading date (0 when the symbol has none that day). A date that
    is no trading date itself counts too; only rows with no trading date after
    them are dropped."""
    return _with_next_return(weights, returns).where(F.col("next_date").isNotNull())


def _with_next_return(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """``weights_to_next_return`` with the rows that have no next date (next_date NULL)."""
    w = _next_trading_date(weights, returns)
    r = returns.select("symbol", F.col("date").alias("next_date"), F.col("ret").alias("next_ret"))
    j = w.join(r, ["symbol", "next_date"], "left")
    return j.withColumn("next_ret", F.coalesce(F.col("next_ret"), F.lit(0.0)))


def _by_portfolio(rows: DataFrame, n_rows: int | None) -> DataFrame:
    return dealt(rows, n_rows, "portfolio_id") if n_rows else rows.repartition("portfolio_id")


def portfolio_returns(weights: DataFrame, returns: DataFrame, n_rows: int | None = None) -> DataFrame:
    """H9: Σ weight · next-day return per (portfolio, date). ``n_rows``: about
    how many weights there are, for the number of partitions."""
    j = _by_portfolio(weights_to_next_return(weights, returns).select("portfolio_id", "date", "weight", "next_ret"), n_rows)
    return j.groupBy("portfolio_id", "date").agg(
        F.sum(F.col("weight") * F.col("next_ret")).alias("port_return"))


def turnover(weights: DataFrame) -> DataFrame:
    """Σ |w_t − w_{t−1}| per (portfolio, date) over the union of the two
    dates' holdings (entries and exits count); before the first date the
    portfolio is equally weighted over its N distinct symbols.

    One pass over the weights, all windows partitioned by portfolio (one
    exchange): the portfolio's previous / next rebalance date come from range
    frames over the date, a symbol's previous / next holding from a window
    per (portfolio, symbol). A holding that continues contributes
    |w_t − w_prev|, a new one |w_t|, an exit |w_prev| at the next date, and
    the first date |w − 1/N| plus 1/N for each symbol not yet held."""
    parts = _with_turnover(weights.where(F.col("portfolio_id").isNotNull()))
    return parts.groupBy("portfolio_id", "date").agg(F.sum("_c").alias("turnover"))


def _with_turnover(weights: DataFrame) -> DataFrame:
    """``weights`` (and what else they carry) with each row's share ``_c`` of its
    date's turnover, and the rows of the exits (``_exit``), which carry only
    portfolio, date and share. All lies by portfolio."""
    wp = Window.partitionBy("portfolio_id")
    wd = wp.orderBy("_d")
    ws = Window.partitionBy("portfolio_id", "symbol").orderBy("date")
    more = [c for c in weights.columns if c not in ("portfolio_id", "date")]
    x = weights.withColumn("_d", F.unix_date("date"))
    x = x.select(
        "*",
        F.max("date").over(wd.rangeBetween(Window.unboundedPreceding, -1)).alias("_prev"),
        F.min("date").over(wd.rangeBetween(1, Window.unboundedFollowing)).alias("_next"),
        F.count(F.lit(1)).over(Window.partitionBy("portfolio_id", "date")).alias("_held"),
        F.row_number().over(ws).alias("_nth"),
        F.lag("date").over(ws).alias("_sym_prev"),
        F.lag("weight").over(ws).alias("_sym_prev_w"),
        F.lead("date").over(ws).alias("_sym_next"),
    )
    x = x.withColumn("_n", F.count_if((F.col("_nth") == 1) & F.col("symbol").isNotNull()).over(wp))     # distinct symbols
    first = F.col("_prev").isNull()
    carried = F.when(F.col("_sym_prev") == F.col("_prev"), F.col("_sym_prev_w")).otherwise(F.lit(0.0))
    here = (F.when(first, F.abs(F.col("weight") - F.try_divide(F.lit(1.0), F.col("_n")))
                   + F.try_divide(F.try_divide(F.col("_n") - F.col("_held"), F.col("_n")), F.col("_held")))
             .otherwise(F.abs(F.col("weight") - carried)))
    leaves = F.col("_next").isNotNull() & (F.col("_sym_next").isNull() | (F.col("_sym_next") != F.col("_next")))
    stays = F.struct(F.col("date"), F.lit(False).alias("_exit"), here.alias("_c"), *[F.col(c) for c in more])
    none = [F.lit(None).cast(weights.schema[c].dataType).alias(c) for c in more]
    gone = F.struct(F.col("_next").alias("date"), F.lit(True).alias("_exit"), F.abs("weight").alias("_c"), *none)
    return (x.select("portfolio_id", F.explode(F.when(leaves, F.array(stays, gone)).otherwise(F.array(stays))).alias("_r"))
             .select("portfolio_id", "_r.*"))


def backtest_ledger(weights: DataFrame, returns: DataFrame, esg_unit: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Per (portfolio, date): portfolio return, value (base 1.0), peak
    (base 1.0), drawdown, turnover, trailing-20 population std of returns (0
    with one row), ESG exposure Σ w·esg (esg_unit 0.5 default).

    The weights meet the next-day returns and the per-symbol ESG table and are
    then dealt by portfolio once: return, exposure and turnover come from one
    aggregation there, the running values from windows. ``n_rows``: about how
    many weights there are, for the number of partitions."""
    j = _with_next_return(weights, returns).join(esg_unit, "symbol", "left")
    j = _by_portfolio(j.select("portfolio_id", "date", "symbol", "weight", "next_date", "next_ret", "esg_unit"), n_rows)
    held = ~F.col("_exit")
    pr = _with_turnover(j).groupBy("portfolio_id", "date").agg(
        F.sum(F.when(held, F.col("weight") * F.col("next_ret"))).alias("port_return"),
        F.sum(F.when(held, F.col("weight") * F.coalesce(F.col("esg_unit"), F.lit(0.5)))).alias("esg"),
        F.sum("_c").alias("turnover"), F.max("next_date").alias("_next_date"))
    pr = pr.where(F.col("_next_date").isNotNull())
    w = Window.partitionBy("portfolio_id").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trail = w.rowsBetween(-(ROLLING_VOL_ROWS - 1), 0)
    led = pr.select(
        "portfolio_id", "date", "port_return", "esg", F.when(F.col("portfolio_id").isNotNull(), F.col("turnover")).alias("turnover"),
        F.product(1 + F.col("port_return")).over(run).alias("value"),
        F.when(F.count(F.lit(1)).over(run) > 1, F.stddev_pop("port_return").over(trail))
         .otherwise(F.lit(0.0)).alias("rolling_vol"),
        F.row_number().over(w).alias("step"),
    )
    led = led.withColumn("peak", F.greatest(F.lit(1.0), F.max("value").over(run)))
    led = led.withColumn("drawdown", (F.col("value") - F.col("peak")) / F.col("peak"))
    return led.withColumn("prev_value", F.coalesce(F.lag("value").over(w), F.lit(1.0)))


def reward_columns(ledger: DataFrame, lam: float = 0.5) -> DataFrame:
    """Log return (0 if the previous value ≤ 0), drawdown reward −|dd|,
    and the combined reward r − .05σ − .001·turnover + λ·esg − .1·max(0, |dd| − .1)."""
    r_log = F.when(F.col("prev_value") <= 0, F.lit(0.0)).otherwise(
        F.log(F.col("value") / F.col("prev_value")))
    excess_dd = F.greatest(F.lit(0.0), F.abs("drawdown") - DRAWDOWN_THRESHOLD)
    combined = (F.col("port_return") - ALPHA_RISK * F.col("rolling_vol")
                - BETA_TURNOVER * F.col("turnover") + lam * F.col("esg")
                - GAMMA_DRAWDOWN * excess_dd)
    return ledger.select("*", r_log.alias("reward_return"), (-F.abs("drawdown")).alias("reward_drawdown"),
                         combined.alias("reward_combined"))


# --------------------------------------------------- H14 / H15 (Arrow pass)

def dsr_step(a: float, b: float, x: float, eta: float) -> tuple[float, float, float | None]:
    """One step of the differential Sharpe ratio: the new moments and the value
    (None where rounding left B below A²)."""
    v = b - a * a
    value = None if v < 0 else 0.0 if v ** 1.5 < DSR_EPS else (b * x - 0.5 * a * x * x) / v ** 1.5
    return a + eta * (x - a), b + eta * (x * x - b), value


def _dsr(r: np.ndarray, eta: float) -> np.ndarray:
    a, b = DSR_A0, DSR_B0
    out = []
    for x in r.tolist():
        a, b, value = dsr_step(a, b, x, eta)
        out.append(np.nan if value is None else value)
    return np.array(out)


def _rtg(r: np.ndarray, gamma: float) -> np.ndarray:
    out = []
    g = 0.0
    for x in reversed(r.tolist()):
        g = x + gamma * g
        out.append(g)
    return np.array(out[::-1])


def _recurrences(eta: float, gamma: float):
    def fn(r: np.ndarray) -> tuple[np.ndarray, ...]:
        g = _rtg(r, gamma)
        if len(g) > 1 and (sd := g.std(ddof=1)) > 0:
            z = (g - g.mean()) / (sd + RTG_EPS)
        else:
            z = g
        return _dsr(r, eta), g, z
    return fn


RECURRENCE_SCHEMA = T.StructType([
    T.StructField("portfolio_id", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("dsr", T.DoubleType()), T.StructField("return_to_go", T.DoubleType()),
    T.StructField("return_to_go_z", T.DoubleType()),
])


def differential_sharpe(ledger: DataFrame, eta: float = DSR_ETA, gamma: float = DISCOUNT) -> DataFrame:
    """H14 + H15: differential Sharpe ratio (A₀=0, B₀=1e-8, η) and the
    discounted return-to-go (γ) with its per-portfolio z-score, in one grouped
    pass per portfolio."""
    src = ledger.select(F.col("portfolio_id").cast("bigint"), "date", "port_return")
    out = run_values(src, "portfolio_id", "date", "port_return", _recurrences(eta, gamma), RECURRENCE_SCHEMA)
    return out.withColumn("dsr", F.when(~F.isnan("dsr"), F.col("dsr")))


# ------------------------------------------------------------- H11, H12

def backtest_summary(ledger: DataFrame, weights: DataFrame) -> DataFrame:
    """H11 per portfolio: total return, annual return / volatility, Sharpe,
    Sortino, max drawdown of the equity curve (first point 1 + r₁), average
    ESG of the mean weights, holdings with mean weight > 1 %, largest mean
    weight, number of days. Mean weights average over all ledger days (a
    missing weight counts 0). ``ledger`` is that of ``weights``: it has every date
    of a portfolio up to its last one."""
    w = Window.partitionBy("portfolio_id").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = ledger.select("portfolio_id", "date", F.col("port_return").alias(risk.RET), "value", "esg") \
                .withColumn("_curve_peak", F.max("value").over(run))
    ann = risk.annual_return(risk.RET)
    perf = led.groupBy("portfolio_id").agg(
        (F.max_by("value", "date") - 1).alias("total_return"),
        ann.alias("annual_return"),
        risk.annual_volatility().alias("annual_volatility"),
        risk.sharpe().alias("sharpe"),
        risk.sortino().alias("sortino"),
        risk.max_drawdown("value", "_curve_peak").alias("max_drawdown"),
        F.count(F.lit(1)).alias("days"),
        (F.sum("esg") / F.count(F.lit(1))).alias("avg_esg"),           # the mean weights' ESG is the mean of the days' exposures
        F.max("date").alias("_last"),
    )
    keys = perf.columns                                     # the portfolio and what is one value for it: perf is worked out once
    w = weights.select("portfolio_id", "symbol", F.col("date").alias("_date"), "weight")
    used = F.col("_date") <= F.col("_last")
    mw = (perf.join(w, "portfolio_id", "left").groupBy(*keys, "symbol")
          .agg((F.sum(F.when(used, F.col("weight"))) / F.col("days")).alias("mean_weight"), F.count_if(used).alias("_used")))
    hold = mw.groupBy(*keys).agg(
        F.count_if(F.col("mean_weight") > HOLDING_MIN_WEIGHT).alias("_holdings"),
        F.max("mean_weight").alias("max_position"), F.sum("_used").alias("_used"))
    held = F.col("_used") > 0
    return hold.select(*[c for c in keys if c not in ("avg_esg", "_last")], F.when(held, F.col("avg_esg")).alias("avg_esg"),
                       F.when(held, F.col("_holdings")).alias("num_holdings"), "max_position")


def benchmark(returns: DataFrame, universe_size: int | None = None) -> DataFrame:
    """Equal-weight benchmark — per date the mean return over the
    universe (a missing return counts 0), compounded."""
    n = universe_size if universe_size is not None else returns.select(F.countDistinct("symbol")).scalar()
    d = returns.groupBy("date").agg((F.sum("ret") / n).alias("ew_return"))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("ew_value", F.product(1 + F.col("ew_return")).over(run))


# ------------------------------------------------------------------- H16

def activate(registry: DataFrame, model_id) -> DataFrame:
    """Activating ``model_id`` retires the currently active model(s) and
    marks the chosen one active; other rows keep their status.
    ``model_id`` may be a literal or a Column (e.g. a scalar subquery)."""
    mid = model_id if hasattr(model_id, "_jc") else F.lit(model_id)
    status = (F.when(F.col("model_id") == mid, F.lit("active"))
               .when(F.col("status") == "active", F.lit("retired"))
               .otherwise(F.col("status")))
    return registry.withColumn("status", status)


def models(registry: DataFrame, created: str = "created_at") -> DataFrame:
    """The registry's rows, newest first."""
    return registry.orderBy(F.desc_nulls_last(created), F.desc("model_id"))


def active(registry: DataFrame) -> DataFrame:
    """The active model row(s) (at most one after ``activate``)."""
    return registry.where(F.col("status") == "active")
