"""Registered queries for model tables, metrics (D1, D2, E), the read surface
(B, D7) and screening (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.operators import metrics as M
from verdant.operators import query as Q
from verdant.plans.catalog import register, sel

_M_DOUBLES = tuple(M.METRIC_COLUMNS + M.ESG_COLUMNS + ["composite_score", "sector_rank_pct"])


def metrics_of(t):
    """computed_metrics as the reference keeps it: a table written by the
    recompute job (here a reliable checkpoint under spark.checkpoint.dir)
    that the read-side queries then read, instead of every reader and every
    scalar subquery re-running the recompute."""
    from verdant.session import checkpoint_dir
    checkpoint_dir(t.spark)
    return M.recompute(t.prices(), t.esg(), t.companies()).checkpoint(eager=True)


def sectors_of(t, metrics=None):
    return M.sector_rankings(metrics if metrics is not None else metrics_of(t), t.companies())


# ------------------------------------------------------------ model tables

@register("fixture_prices_daily", """
select symbol, date, round(low, 6) as low, round(high, 6) as high, round(close, 6) as close,
       volume from m_prices""")
def fixture_prices_daily(t):
    """prices_daily derived from lineitem (FIXTURES.md §3)."""
    return t.prices()


@register("fixture_esg_scores", """
select symbol, date, provider, round(e_score, 6) as e_score, round(s_score, 6) as s_score,
       round(g_score, 6) as g_score, round(composite_score, 6) as composite_score from m_esg""")
def fixture_esg_scores(t):
    """esg_scores derived from lineitem ⋈ supplier."""
    return t.esg()


# --------------------------------------------------------------- D1, E, D2

@register("d1_esg_averages", f"""
select {sel('symbol', 'avg_esg_composite', 'avg_e_score', 'avg_s_score', 'avg_g_score',
            doubles=('avg_esg_composite', 'avg_e_score', 'avg_s_score', 'avg_g_score'))}
from m_esgavg""")
def d1_esg_averages(t):
    return M.esg_averages(t.esg())


@register("e1_returns", """
select symbol, date, round(ret, 6) as ret from m_path where ret is not null""")
def e1_returns(t):
    """Simple daily return per symbol (first date dropped)."""
    from verdant.functions import risk
    p = risk.return_path(t.prices())
    return p.where(F.col("ret").isNotNull()).select("symbol", "date", "ret")


@register("e10_computed_metrics", f"""
select {sel('symbol', 'as_of_date', *M.METRIC_COLUMNS, *M.ESG_COLUMNS, 'composite_score',
            'eligible_hard_screen', 'sector_rank_pct', 'n_closes', 'n_returns', doubles=_M_DOUBLES)}
from m_metrics""")
def e10_computed_metrics(t):
    """E10 + G1–G3: computed_metrics for all companies with ≥ 60 closes."""
    return metrics_of(t)


@register("d2_sector_rankings", """
select sector, as_of_date, company_count, round(avg_sharpe, 6) as avg_sharpe,
  round(avg_esg, 6) as avg_esg, round(avg_volatility, 6) as avg_volatility,
  round(avg_return, 6) as avg_return, round(composite_score, 6) as composite_score
from m_sector_rankings""")
def d2_sector_rankings(t):
    return sectors_of(t)


# ------------------------------------------------------------------- B, D7

_B1_COLS = ("symbol", "name", "sector", "sharpe", "esg", "volatility", "annual_return",
            "max_drawdown", "composite_score")
_B1_D = ("sharpe", "esg", "volatility", "annual_return", "max_drawdown", "composite_score")
_B1_SQL = """
select m.symbol, c.name, c.sector,
  round(coalesce(sharpe_252d, 0), 6) as sharpe, round(coalesce(avg_esg_composite, 0), 6) as esg,
  round(coalesce(annual_volatility, 0), 6) as volatility,
  round(coalesce(annual_return, 0), 6) as annual_return,
  round(coalesce(max_drawdown, 0), 6) as max_drawdown,
  round(coalesce(composite_score, 0), 6) as composite_score
from m_metrics m join m_companies c on m.symbol = c.symbol
{where}
order by m.composite_score desc nulls last, m.symbol limit {n}"""


@register("b1_best_companies", _B1_SQL.format(where="", n=10))
def b1_best_companies(t):
    """B1: top 10 companies by composite score (flagship query)."""
    return Q.best_companies(metrics_of(t), t.companies(), top_n=10)


@register("b1_best_companies_filtered", _B1_SQL.format(
    where="where c.sector = 'ASIA' and m.avg_esg_composite >= 20 and m.sharpe_252d >= 2.0", n=10))
def b1_best_companies_filtered(t):
    """B1 with sector / ESG / Sharpe floors."""
    return Q.best_companies(metrics_of(t), t.companies(), sector="ASIA", min_esg=20,
                            min_sharpe=2.0, top_n=10)


@register("b2_metrics_by_momentum", f"""
select {sel('m.symbol', 'as_of_date', *M.METRIC_COLUMNS, *M.ESG_COLUMNS, 'composite_score',
            'eligible_hard_screen', 'sector_rank_pct', doubles=_M_DOUBLES)}
from m_metrics m join m_companies c on m.symbol = c.symbol
where m.avg_esg_composite >= 10
order by momentum_60d desc nulls last, m.symbol limit 50""")
def b2_metrics_by_momentum(t):
    """B2: metric listing sorted by a white-listed column (60-day momentum)."""
    return Q.metrics_sorted(metrics_of(t), t.companies(), min_esg=10,
                            sort_by="momentum_60d", limit=50)


_DETAIL_SQL = ", ".join(
    (f"round({a}, 6) as {b}" if a != "eligible_hard_screen" else f"{a} as {b}")
    for a, b in Q.DETAIL_COLUMNS)


@register("b3_company_detail", f"""
select upper(trim(lower(c.symbol))) as symbol, c.name, c.sector, c.sub_industry,
  c.restricted_business, c.severe_controversy, {_DETAIL_SQL}
from m_companies c join m_metrics m on upper(trim(lower(c.symbol))) = m.symbol""")
def b3_company_detail(t):
    """Detail for every company, requested by lower-case symbol."""
    req = t.companies().select(F.lower("symbol").alias("symbol"))
    return Q.company_detail(metrics_of(t), t.companies(), req)


@register("b4_compare_holdings", f"""
with req as (
  select portfolio_id as request_id,
         row_number() over (partition by portfolio_id order by weight desc, symbol) as pos,
         lower(symbol) as symbol
  from m_holdings)
select r.request_id, r.pos, upper(trim(r.symbol)) as symbol, c.name, c.sector, c.sub_industry,
  c.restricted_business, c.severe_controversy, {_DETAIL_SQL}
from req r join m_companies c on upper(trim(r.symbol)) = c.symbol
           join m_metrics m on upper(trim(r.symbol)) = m.symbol""")
def b4_compare_holdings(t):
    """Side-by-side comparison, one request per portfolio listing its
    holdings by weight."""
    from pyspark.sql import Window
    h = t.holdings()
    w = Window.partitionBy("portfolio_id").orderBy(F.desc("weight"), F.asc("symbol"))
    req = h.select(F.col("portfolio_id").alias("request_id"),
                   F.row_number().over(w).alias("pos"),
                   F.lower("symbol").alias("symbol"))
    return Q.compare(metrics_of(t), t.companies(), req)


@register("b5_company_page", """
select * from m_companies where sector = 'EUROPE' order by symbol limit 20 offset 5""")
def b5_company_page(t):
    """One page of companies of a sector."""
    return Q.list_companies(t.companies(), sector="EUROPE", limit=20, offset=5)


_B6_SQL = """
select sector, round(coalesce(avg_sharpe, 0), 6) as avg_sharpe, round(coalesce(avg_esg, 0), 6) as avg_esg,
  round(coalesce(avg_volatility, 0), 6) as avg_volatility, round(coalesce(avg_return, 0), 6) as avg_return,
  coalesce(company_count, 0) as company_count, round(coalesce(composite_score, 0), 6) as composite_score
from m_sector_rankings order by {order}, sector limit {n}"""


@register("b6_sector_leaderboard", _B6_SQL.format(order="composite_score desc nulls last", n=5))
def b6_sector_leaderboard(t):
    """Top 5 sectors by composite."""
    return Q.sector_leaderboard(sectors_of(t), "composite", 5)


@register("b6_sector_low_risk", _B6_SQL.format(order="avg_volatility asc nulls last", n=3))
def b6_sector_low_risk(t):
    """3 lowest-volatility sectors (ascending, the documented intent)."""
    return Q.sector_leaderboard(sectors_of(t), "low_risk", 3)


@register("b7_sector_detail", """
with top as (
  select m.*, c.name, c.sector,
    row_number() over (partition by c.sector order by m.composite_score desc nulls last, m.symbol) as company_rank
  from m_metrics m join m_companies c on m.symbol = c.symbol where c.sector is not null)
select t.sector, round(coalesce(s.avg_sharpe, 0), 6) as sector_avg_sharpe,
  round(coalesce(s.avg_esg, 0), 6) as sector_avg_esg,
  round(coalesce(s.avg_volatility, 0), 6) as sector_avg_volatility,
  coalesce(s.company_count, 0) as sector_company_count, t.company_rank, t.symbol, t.name,
  round(coalesce(t.sharpe_252d, 0), 6) as sharpe, round(coalesce(t.avg_esg_composite, 0), 6) as esg,
  round(coalesce(t.annual_volatility, 0), 6) as volatility,
  round(coalesce(t.annual_return, 0), 6) as annual_return,
  round(coalesce(t.composite_score, 0), 6) as composite_score
from top t left join m_sector_rankings s on t.sector = s.sector
where t.company_rank <= 10""")
def b7_sector_detail(t):
    """Every sector with its top 10 companies by composite."""
    m = metrics_of(t)
    return Q.sector_detail(sectors_of(t, m), m, t.companies(), k=10)


_B8_CASES = [
    "case when sharpe_252d < 0 or sharpe_252d > 3 then 'sharpe_out_of_range' end",
    "case when avg_esg_composite < 0 or avg_esg_composite > 100 then 'esg_out_of_range' end",
    "case when annual_volatility < 0.05 or annual_volatility > 0.40 then 'volatility_out_of_range' end",
    "case when max_drawdown < -0.60 or max_drawdown > -0.05 then 'drawdown_out_of_range' end",
]


@register("b8_plausibility_flags", f"""
select symbol, as_of_date, round(sharpe_252d, 6) as sharpe_252d,
  round(avg_esg_composite, 6) as avg_esg_composite, round(annual_volatility, 6) as annual_volatility,
  round(max_drawdown, 6) as max_drawdown,
  concat_ws(',', {', '.join(_B8_CASES)}) as flags,
  {' + '.join(f'(({c}) is not null)::bigint' for c in _B8_CASES)} as n_flags
from m_metrics""")
def b8_plausibility_flags(t):
    """Implausible metric values per company."""
    f = Q.plausibility_flags(metrics_of(t))
    return f.withColumn("flags", F.array_join("flags", ","))


@register("d7_latest_snapshot", f"""
select {sel('symbol', 'as_of_date', *M.METRIC_COLUMNS, *M.ESG_COLUMNS, 'composite_score',
            'eligible_hard_screen', 'sector_rank_pct', 'n_closes', 'n_returns', doubles=_M_DOUBLES)}
from m_metrics""")
def d7_latest_snapshot(t):
    """Latest row per symbol over a two-snapshot history (yesterday's
    snapshot, dated one day earlier with shifted values, is superseded)."""
    m = metrics_of(t)
    old = m.withColumn("as_of_date", F.date_sub("as_of_date", 1)) \
           .withColumn("sharpe_252d", F.col("sharpe_252d") + 1)
    return Q.latest(old.unionByName(m), "symbol").select(*m.columns)
