"""Read-side operators: latest snapshot (D7), ranked listings and lookups
(B1–B8) and the small joins they share (C1–C5).

Ordering rules: a NULL score never ranks first (``desc_nulls_last``) and every
top-k breaks ties by key, so results are deterministic. Top-k is
``orderBy(...).limit(k)`` (TakeOrderedAndProject: per-partition top-k, then one
small merge) or ``row_number() <= k`` per group (Catalyst adds a
WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.operators.metrics import ESG_COLUMNS, METRIC_COLUMNS

# Sort white-lists and result caps.
METRIC_SORT_COLUMNS = (
    "composite_score", "sharpe_252d", "sortino_252d", "calmar_ratio", "annual_return",
    "annual_volatility", "avg_esg_composite", "max_drawdown", "momentum_20d", "momentum_60d",
)
SECTOR_SORT = {"composite": "composite_score", "sharpe": "avg_sharpe",
               "esg": "avg_esg", "low_risk": "avg_volatility"}
BEST_MAX_N = 100
SECTOR_MAX_N = 11


def clamp(n: int, lo: int, hi: int) -> int:
    return max(lo, min(int(n), hi))


# ---------------------------------------------------------------- D7, C1–C5

def latest(df: DataFrame, keys: Sequence[str] | str, ts: str = "as_of_date") -> DataFrame:
    """Newest ``ts`` row per key, as one aggregation with map-side
    partial aggregation (``max_by`` over a struct of the row)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(F.max_by(row, F.col(ts)).alias("_row"))
              .select(*keys, "_row.*"))


def with_company(metrics: DataFrame, companies: DataFrame) -> DataFrame:
    """Metrics ⋈ companies on symbol (inner)."""
    return metrics.join(companies, "symbol")


def with_metrics(companies: DataFrame, metrics: DataFrame) -> DataFrame:
    """Companies ⟕ metrics (companies without metrics kept)."""
    return companies.join(metrics, "symbol", "left")


def only_symbols(df: DataFrame, symbols: DataFrame, col: str = "symbol") -> DataFrame:
    """Semi join against a symbol table (never a driver-built list)."""
    return df.join(symbols.select(F.col(col).alias("symbol")).distinct(), "symbol", "left_semi")


def without_sectors(df: DataFrame, excluded: DataFrame | Sequence[str] | None) -> DataFrame:
    """C4: ``NOT sector IN (excluded)`` with SQL three-valued logic: when an
    exclusion list is given, NULL-sector rows are dropped too; with no list
    nothing is removed."""
    if excluded is None:
        return df
    if isinstance(excluded, DataFrame):
        ex = excluded.select(F.col(excluded.columns[0]).alias("_ex_sector")).distinct()
        kept = df.where(F.col("sector").isNotNull())
        return kept.join(ex, kept.sector == ex._ex_sector, "left_anti")
    if len(excluded) == 0:
        return df
    return df.where(~F.col("sector").isin(list(excluded)))


def not_self(pairs: DataFrame, left: str = "ref_symbol", right: str = "symbol") -> DataFrame:
    """Drop a row paired with itself."""
    return pairs.where(F.col(left) != F.col(right))


# ------------------------------------------------------------------ B1–B8

def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def best_companies(metrics: DataFrame, companies: DataFrame, sector: str | None = None,
                   min_esg: float | None = None, min_sharpe: float | None = None,
                   top_n: int = 10) -> DataFrame:
    """B1: companies ranked by composite score with optional sector / ESG /
    Sharpe floors; top 1–100; NULL measures shown as 0."""
    top_n = clamp(top_n, 1, BEST_MAX_N)
    m = latest(metrics, "symbol")
    j = with_company(m.select("symbol", "sharpe_252d", "avg_esg_composite", "annual_volatility",
                              "annual_return", "max_drawdown", "composite_score"),
                     companies.select("symbol", "name", "sector"))
    if sector:
        j = j.where(F.col("sector") == sector)
    if min_esg is not None:
        j = j.where(F.col("avg_esg_composite") >= min_esg)
    if min_sharpe is not None:
        j = j.where(F.col("sharpe_252d") >= min_sharpe)
    top = j.orderBy(F.desc_nulls_last("composite_score"), F.asc("symbol")).limit(top_n)
    return top.select(
        "symbol", "name", "sector",
        _zero("sharpe_252d").alias("sharpe"), _zero("avg_esg_composite").alias("esg"),
        _zero("annual_volatility").alias("volatility"), _zero("annual_return").alias("annual_return"),
        _zero("max_drawdown").alias("max_drawdown"), _zero("composite_score").alias("composite_score"),
    )


def metrics_sorted(metrics: DataFrame, companies: DataFrame, sector: str | None = None,
                   min_esg: float | None = None, min_sharpe: float | None = None,
                   sort_by: str = "composite_score", limit: int = 50) -> DataFrame:
    """B2: metric rows filtered like B1 and sorted descending by one of the
    white-listed columns (unknown name → composite_score)."""
    col = sort_by if sort_by in METRIC_SORT_COLUMNS else "composite_score"
    m = latest(metrics, "symbol")
    j = m.join(companies.select("symbol", "sector"), "symbol")
    if sector:
        j = j.where(F.col("sector") == sector)
    if min_esg is not None:
        j = j.where(F.col("avg_esg_composite") >= min_esg)
    if min_sharpe is not None:
        j = j.where(F.col("sharpe_252d") >= min_sharpe)
    out = j.orderBy(F.desc_nulls_last(col), F.asc("symbol")).limit(int(limit))
    return out.select("symbol", "as_of_date", *METRIC_COLUMNS, *ESG_COLUMNS,
                      "composite_score", "eligible_hard_screen", "sector_rank_pct")


DETAIL_COLUMNS = [
    ("sharpe_252d", "sharpe"), ("sortino_252d", "sortino"), ("calmar_ratio", "calmar"),
    ("annual_return", "annual_return"), ("annual_volatility", "volatility"),
    ("max_drawdown", "max_drawdown"), ("momentum_20d", "momentum_20d"),
    ("momentum_60d", "momentum_60d"), ("avg_esg_composite", "esg_composite"),
    ("avg_e_score", "e_score"), ("avg_s_score", "s_score"), ("avg_g_score", "g_score"),
    ("sector_rank_pct", "sector_rank_pct"), ("eligible_hard_screen", "eligible"),
    ("composite_score", "composite_score"),
]


def company_detail(metrics: DataFrame, companies: DataFrame, requests: DataFrame,
                   symbol_col: str = "symbol") -> DataFrame:
    """Full detail for each requested symbol (case-insensitive); unknown
    symbols give no row; a true 0.0 stays 0.0."""
    req = requests.select(F.upper(F.trim(F.col(symbol_col))).alias("symbol"),
                          *[c for c in requests.columns if c != symbol_col])
    m = latest(metrics, "symbol")
    c = companies.select("symbol", "name", "sector", "sub_industry",
                         "restricted_business", "severe_controversy")
    j = req.join(c, "symbol").join(m, "symbol")
    return j.select(*req.columns, "name", "sector", "sub_industry", "restricted_business",
                    "severe_controversy", *[F.col(a).alias(b) for a, b in DETAIL_COLUMNS])


def compare(metrics: DataFrame, companies: DataFrame, requests: DataFrame) -> DataFrame:
    """Side-by-side detail for requests(request_id, pos, symbol); unknown
    symbols dropped, repeats kept, rows carry their request position."""
    return company_detail(metrics, companies,
                          requests.select("request_id", "pos", "symbol"))


def list_companies(companies: DataFrame, sector: str | None = None,
                   limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of companies (by symbol), optional sector filter."""
    c = companies
    if sector:
        c = c.where(F.col("sector") == sector)
    return c.orderBy("symbol").offset(int(offset)).limit(int(limit))


def sector_leaderboard(sectors: DataFrame, sort_by: str = "composite",
                       top_n: int = 5) -> DataFrame:
    """Latest sector rows sorted by composite / sharpe / esg descending,
    or low_risk by volatility ascending; top 1–11; NULL shown as 0."""
    col = SECTOR_SORT.get(sort_by, "composite_score")
    s = latest(sectors, "sector")
    order = F.asc_nulls_last(col) if sort_by == "low_risk" else F.desc_nulls_last(col)
    top = s.orderBy(order, F.asc("sector")).limit(clamp(top_n, 1, SECTOR_MAX_N))
    return top.select(
        "sector", _zero("avg_sharpe").alias("avg_sharpe"), _zero("avg_esg").alias("avg_esg"),
        _zero("avg_volatility").alias("avg_volatility"), _zero("avg_return").alias("avg_return"),
        F.coalesce(F.col("company_count"), F.lit(0)).cast("bigint").alias("company_count"),
        _zero("composite_score").alias("composite_score"))


def sector_detail(sectors: DataFrame, metrics: DataFrame, companies: DataFrame,
                  only: DataFrame | None = None, k: int = 10) -> DataFrame:
    """For every sector at once, its ranking row and its top-k companies by
    composite (row_number per sector ≤ k)."""
    m = latest(metrics, "symbol").select("symbol", "sharpe_252d", "avg_esg_composite",
                                         "annual_volatility", "annual_return", "composite_score")
    j = m.join(companies.select("symbol", "name", "sector").where(F.col("sector").isNotNull()),
               "symbol")
    if only is not None:
        j = j.join(only.select(F.col(only.columns[0]).alias("sector")), "sector", "left_semi")
    w = Window.partitionBy("sector").orderBy(F.desc_nulls_last("composite_score"), F.asc("symbol"))
    top = j.withColumn("company_rank", F.row_number().over(w)).where(F.col("company_rank") <= k)
    s = latest(sectors, "sector").select(
        "sector", _zero("avg_sharpe").alias("sector_avg_sharpe"),
        _zero("avg_esg").alias("sector_avg_esg"),
        _zero("avg_volatility").alias("sector_avg_volatility"),
        F.coalesce(F.col("company_count"), F.lit(0)).cast("bigint").alias("sector_company_count"))
    out = top.join(s, "sector", "left")
    return out.select(
        "sector", "sector_avg_sharpe", "sector_avg_esg", "sector_avg_volatility",
        "sector_company_count", F.col("company_rank").cast("bigint").alias("company_rank"),
        "symbol", "name", _zero("sharpe_252d").alias("sharpe"),
        _zero("avg_esg_composite").alias("esg"), _zero("annual_volatility").alias("volatility"),
        _zero("annual_return").alias("annual_return"),
        _zero("composite_score").alias("composite_score"))


# Plausibility ranges of a metric review.
PLAUSIBLE = {
    "sharpe_252d": (0.0, 3.0, "sharpe_out_of_range"),
    "avg_esg_composite": (0.0, 100.0, "esg_out_of_range"),
    "annual_volatility": (0.05, 0.40, "volatility_out_of_range"),
    "max_drawdown": (-0.60, -0.05, "drawdown_out_of_range"),
}


def plausibility_flags(metrics: DataFrame) -> DataFrame:
    """Per metric row, the list of implausible measures (NULLs are not
    flagged) and their count."""
    checks = [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(name))
              for c, (lo, hi, name) in PLAUSIBLE.items()]
    flags = F.array_compact(F.array(*checks))
    return (metrics.select("symbol", "as_of_date", *PLAUSIBLE.keys())
                   .withColumn("flags", flags)
                   .withColumn("n_flags", F.size("flags").cast("bigint")))
