"""Metric recompute (E10), ESG averages (D1), sector rankings (D2) and the
company-level screening columns (G1–G3).

Plan shape of ``recompute``: prices are shuffled once by symbol; the windowed
return path and the per-symbol aggregation share that partitioning. ESG
averages are a partial/final aggregation of their own; the company dimension is
joined by symbol (Spark broadcasts it when its measured size allows, AQE
re-plans at run time otherwise). The per-symbol group size is bounded by the
number of trading dates, because prices are keyed by (symbol, date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.functions import risk

# Fixed values of the recompute rule.
MIN_CLOSES = 60      # symbols with fewer closes are skipped
MIN_RETURNS = 20     # fewer returns: only the keys are written
HARD_SCREEN_MIN_ESG = 20.0

METRIC_COLUMNS = [
    "annual_return", "annual_volatility", "sharpe_252d", "sortino_252d",
    "calmar_ratio", "max_drawdown", "momentum_20d", "momentum_60d",
]
ESG_COLUMNS = ["avg_esg_composite", "avg_e_score", "avg_s_score", "avg_g_score"]


def esg_averages(esg: DataFrame) -> DataFrame:
    """Mean composite / E / S / G per symbol over all dates and providers
    (NULLs ignored)."""
    return esg.groupBy("symbol").agg(
        F.avg("composite_score").alias("avg_esg_composite"),
        F.avg("e_score").alias("avg_e_score"),
        F.avg("s_score").alias("avg_s_score"),
        F.avg("g_score").alias("avg_g_score"),
    )


def composite_score(sharpe: Column | str = "sharpe_252d",
                    esg: Column | str = "avg_esg_composite",
                    vol: Column | str = "annual_volatility") -> Column:
    """G1: 0.4·sharpe + 0.4·esg/100 + 0.2·(1 − volatility); NULL if any input is."""
    s = F.col(sharpe) if isinstance(sharpe, str) else sharpe
    e = F.col(esg) if isinstance(esg, str) else esg
    v = F.col(vol) if isinstance(vol, str) else vol
    return 0.4 * s + 0.4 * (e / 100) + 0.2 * (1 - v)


def symbol_metrics(prices: DataFrame, key: str = "symbol") -> DataFrame:
    """E1–E9 for every key: one windowed pass and one aggregation.

    Returns key, n_closes, n_returns and the eight metric columns (NULL when
    the key has fewer than MIN_RETURNS returns)."""
    path = risk.return_path(prices.select(key, "date", "close"), key=key)
    ann = risk.annual_return_from_prices()
    mdd_r = risk.max_drawdown_returns()
    agg = path.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_closes"),
        F.count(risk.RET).alias("n_returns"),
        ann.alias("annual_return"),
        risk.annual_volatility().alias("annual_volatility"),
        risk.sharpe().alias("sharpe_252d"),
        risk.sortino().alias("sortino_252d"),
        risk.calmar(ann, mdd_r).alias("calmar_ratio"),
        risk.max_drawdown().alias("max_drawdown"),
        risk.momentum(20).alias("momentum_20d"),
        risk.momentum(60).alias("momentum_60d"),
    )
    enough = F.col("n_returns") >= MIN_RETURNS
    return agg.select(key, "n_closes", "n_returns",
                      *[F.when(enough, F.col(c)).alias(c) for c in METRIC_COLUMNS])


def sector_rank_pct(df: DataFrame, value: str = "composite_score",
                    group: str = "sector") -> Column:
    """G3 as a column: average-tie ascending rank of ``value`` within ``group``
    divided by the number of non-NULL values there (pandas rank(pct=True)).
    NULL for a NULL group or value. One partitioning by ``group``."""
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last(value))
    peers = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
    rank = F.rank().over(w)
    n = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    avg_rank = rank + (peers - 1) / 2.0
    return (F.when(F.col(group).isNull() | F.col(value).isNull(), F.lit(None).cast("double"))
             .otherwise(F.try_divide(avg_rank, n)))


def recompute(prices: DataFrame, esg: DataFrame, companies: DataFrame,
              as_of: Column | str | None = None) -> DataFrame:
    """E10 (+ G1–G3): computed_metrics for every company with at least
    MIN_CLOSES closes.

    Columns: symbol, as_of_date, the eight metrics, the four ESG averages,
    composite_score, eligible_hard_screen, sector_rank_pct, plus n_closes,
    n_returns. ``as_of`` defaults to the newest price date (a scalar subquery).
    """
    per = symbol_metrics(prices).where(F.col("n_closes") >= MIN_CLOSES)
    comp = companies.select("symbol", "sector", "restricted_business", "severe_controversy")
    m = (per.join(comp, "symbol")
            .join(esg_averages(esg), "symbol", "left"))
    if as_of is None:
        as_of_col = prices.select(F.max("date")).scalar()
    elif isinstance(as_of, str):
        as_of_col = F.lit(as_of).cast("date")
    else:
        as_of_col = as_of
    m = m.withColumn("as_of_date", as_of_col)
    m = m.withColumn("composite_score", composite_score())
    m = m.withColumn("eligible_hard_screen", hard_screen_flag())
    m = m.withColumn("sector_rank_pct", sector_rank_pct(m))
    return m.select("symbol", "as_of_date", *METRIC_COLUMNS, *ESG_COLUMNS,
                    "composite_score", "eligible_hard_screen", "sector_rank_pct",
                    "n_closes", "n_returns")


def hard_screen_flag(min_esg: float = HARD_SCREEN_MIN_ESG) -> Column:
    """G2 flag: not restricted, no severe controversy, ESG ≥ min (NULL fails)."""
    return F.coalesce(
        ~F.col("restricted_business") & ~F.col("severe_controversy")
        & (F.col("avg_esg_composite") >= min_esg),
        F.lit(False))


def sector_rankings(metrics: DataFrame, companies: DataFrame,
                    as_of: Column | str | None = None) -> DataFrame:
    """Per sector (symbols with a sector): count, mean Sharpe / ESG /
    volatility / return over non-NULL values (0 when none) and
    composite = 0.4·sharpe + 0.4·esg/100 + 0.2·(1 − vol)."""
    m = metrics.select("symbol", "as_of_date", "sharpe_252d", "avg_esg_composite",
                       "annual_volatility", "annual_return")
    j = m.join(companies.select("symbol", "sector"), "symbol").where(F.col("sector").isNotNull())
    g = j.groupBy("sector").agg(
        F.max("as_of_date").alias("as_of_date"),
        F.count(F.lit(1)).alias("company_count"),
        F.coalesce(F.avg("sharpe_252d"), F.lit(0.0)).alias("avg_sharpe"),
        F.coalesce(F.avg("avg_esg_composite"), F.lit(0.0)).alias("avg_esg"),
        F.coalesce(F.avg("annual_volatility"), F.lit(0.0)).alias("avg_volatility"),
        F.coalesce(F.avg("annual_return"), F.lit(0.0)).alias("avg_return"),
    )
    if as_of is not None:
        g = g.withColumn("as_of_date", F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of)
    return g.withColumn("composite_score",
                        composite_score("avg_sharpe", "avg_esg", "avg_volatility"))
