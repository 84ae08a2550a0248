"""Registered queries for screening (G), features (D5, D6, F) and portfolios /
back-tests (D3, D4, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdant.functions import risk
from verdant.operators import backtest as B
from verdant.operators import features as FE
from verdant.operators import portfolio as P
from verdant.operators import screen as S
from verdant.plans.catalog import register, sig_sql
from verdant.plans.oracle import cte
from verdant.plans.queries_read import metrics_of
from verdant.streaming.pipelines import scratch

# ------------------------------------------------------------------ G

cte("m_eligible", """
select m.symbol, c.sector, m.composite_score
from m_metrics m join m_companies c on m.symbol = c.symbol
where coalesce(not c.restricted_business and not c.severe_controversy
               and m.avg_esg_composite >= 20 and m.eligible_hard_screen, false)
""")

cte("m_soft", """
select symbol, sector, composite_score, rank_pct from (
  select *, case when composite_score is null then null else
      (rank() over (partition by sector order by composite_score asc nulls last)
       + (count(*) over (partition by sector, composite_score) - 1) / 2.0e0)
      / count(composite_score) over (partition by sector) end as rank_pct
  from m_eligible where sector is not null) x
where rank_pct >= 0.5
union all
select symbol, sector, composite_score, cast(null as double) as rank_pct
from m_eligible where (select count(*) from m_eligible where sector is not null) = 0
""")


@register("g2_hard_screen", """
select symbol, sector, round(composite_score, 6) as composite_score from m_eligible""")
def g2_hard_screen(t):
    """Companies passing the hard screen."""
    return S.hard_screen(metrics_of(t), t.companies())


@register("g4_soft_screen", """
select symbol, sector, round(composite_score, 6) as composite_score, round(rank_pct, 6) as rank_pct
from m_soft""")
def g4_soft_screen(t):
    """Best-in-class half of each sector among eligible companies."""
    return S.soft_screen(S.hard_screen(metrics_of(t), t.companies()))


@register("g5_select_universe", """
select symbol, sector, round(composite_score, 6) as composite_score from (
  select symbol, sector, composite_score from m_soft
  union all
  select m.symbol, c.sector, m.composite_score from m_metrics m join m_companies c on m.symbol = c.symbol
  where (select count(*) from m_eligible) = 0) u
order by composite_score desc nulls last, symbol limit 30""")
def g5_select_universe(t):
    """Training universe — hard → soft → top 30 by composite."""
    return S.select_universe(metrics_of(t), t.companies(), 30)


_PARETO_SQL = """
with pool as (
  select {keys} m.symbol, c.name, m.sharpe_252d, m.avg_esg_composite,
         row_number() over ({part} order by m.sharpe_252d desc, m.avg_esg_composite desc, m.symbol) as pos
  from m_metrics m join m_companies c on m.symbol = c.symbol
  where m.sharpe_252d is not null and m.avg_esg_composite is not null),
walk as (
  select *, coalesce(max(avg_esg_composite) over ({part2} order by pos
            rows between unbounded preceding and 1 preceding), -1.0e0) as best_above
  from pool),
front as (
  select *, row_number() over ({part2} order by pos) as frontier_rank
  from walk where avg_esg_composite > best_above)
select {keys2} frontier_rank, symbol, name, round(sharpe_252d, 6) as sharpe,
       round(avg_esg_composite, 6) as esg
from front where frontier_rank <= 20"""


@register("g6_pareto_frontier", _PARETO_SQL.format(keys="", part="", part2="", keys2=""))
def g6_pareto_frontier(t):
    """The first 20 rows of the Sharpe / ESG Pareto frontier of all companies."""
    return S.pareto(metrics_of(t), t.companies(), top_n=20)


@register("g6_pareto_by_sector", _PARETO_SQL.format(
    keys="c.sector,", part="partition by c.sector", part2="partition by sector", keys2="sector,"))
def g6_pareto_by_sector(t):
    """G6 per sector: one frontier per sector (NULL sector its own group)."""
    return S.pareto(metrics_of(t), t.companies(), top_n=20, by="sector")


@register("g6_pareto_all", """
with r as (
  select m.symbol, c.name, m.sharpe_252d, m.avg_esg_composite,
    coalesce(max(m.avg_esg_composite) over (order by m.sharpe_252d desc, m.avg_esg_composite desc, m.symbol
             rows between unbounded preceding and 1 preceding), -1.0e0) as best_above
  from m_metrics m join m_companies c on m.symbol = c.symbol
  where m.sharpe_252d is not null and m.avg_esg_composite is not null)
select symbol, name, round(sharpe_252d, 6) as sharpe, round(avg_esg_composite, 6) as esg
from r where avg_esg_composite > best_above""")
def g6_pareto_all(t):
    """G6 without a pool: the frontier of every company (distributed skyline)."""
    return S.pareto_all(metrics_of(t), t.companies())


# ------------------------------------------------------------------ F, D5, D6

cte("m_feat0", """
select symbol, date, close,
  close / lag(close, 1) over w - 1 as f0_return,
  close / lag(close, 20) over w - 1 as f1_mom20,
  close / lag(close, 60) over w - 1 as f2_mom60,
  case when count(close) over w60 >= 60 then close / max(close) over w60 - 1 end as f4_dd60,
  coalesce(100 - 100 / (1 + (case when count(*) over w14 >= 14 then avg(gain) over w14 end)
           / nullif(case when count(*) over w14 >= 14 then avg(loss) over w14 end, 0)), 50.0e0) / 100.0e0 as f8_rsi,
  case when count(close) over w20 >= 20 then avg(close) over w20 end as sma20,
  case when count(close) over w20 >= 20 then stddev_samp(close) over w20 end as sd20
from (select symbol, date, close,
        case when close - lag(close) over (partition by symbol order by date) > 0
             then close - lag(close) over (partition by symbol order by date) else 0.0e0 end as gain,
        -(case when close - lag(close) over (partition by symbol order by date) < 0
             then close - lag(close) over (partition by symbol order by date) else 0.0e0 end) as loss
      from m_prices where close is not null) p
window w as (partition by symbol order by date),
       w14 as (partition by symbol order by date rows between 13 preceding and current row),
       w20 as (partition by symbol order by date rows between 19 preceding and current row),
       w60 as (partition by symbol order by date rows between 59 preceding and current row)
""")

cte("m_feat", """
select symbol, date, close, f0_return, f1_mom20, f2_mom60,
  case when count(f0_return) over (partition by symbol order by date rows between 19 preceding and current row) >= 20
       then stddev_samp(f0_return) over (partition by symbol order by date rows between 19 preceding and current row)
  end as f3_vol20,
  f4_dd60, f8_rsi,
  coalesce((close - (sma20 - 2 * sd20)) / nullif((sma20 + 2 * sd20) - (sma20 - 2 * sd20), 0), 0.5e0) as f9_pct_b
from m_feat0
""")

cte("m_esgunit", "select symbol, avg(composite_score) / 100 as esg_unit from m_esg group by symbol")

cte("m_ema", """
select * from (
  with recursive base as (
    select symbol, date, close, row_number() over (partition by symbol order by date) as rn
    from m_prices where close is not null),
  ema(symbol, rn, date, e12, e26, sig) as (
    select symbol, rn, date, close, close, 0.0e0 from base where rn = 1
    union all
    select b.symbol, b.rn, b.date,
      (2.0e0/13.0e0) * b.close + (1.0e0 - 2.0e0/13.0e0) * e.e12,
      (2.0e0/27.0e0) * b.close + (1.0e0 - 2.0e0/27.0e0) * e.e26,
      (2.0e0/10.0e0) * (((2.0e0/13.0e0) * b.close + (1.0e0 - 2.0e0/13.0e0) * e.e12)
                        - ((2.0e0/27.0e0) * b.close + (1.0e0 - 2.0e0/27.0e0) * e.e26))
        + (1.0e0 - 2.0e0/10.0e0) * e.sig
    from ema e join base b on b.symbol = e.symbol and b.rn = e.rn + 1)
  select symbol, date, e12 as ema_fast, e26 as ema_slow, e12 - e26 as macd, sig as macd_signal,
         (e12 - e26) - sig as macd_hist from ema) q
""")

_FEATS = ["f0_return", "f1_mom20", "f2_mom60", "f3_vol20", "f4_dd60", "f5_esg1", "f6_esg2",
          "f7_macd", "f8_rsi", "f9_pct_b", "f10_volume_change"]

cte("m_panel", """
select f.symbol, f.date, f.close, f0_return, f1_mom20, f2_mom60, f3_vol20, f4_dd60,
  coalesce(u.esg_unit, 0.5e0) as f5_esg1, coalesce(u.esg_unit, 0.5e0) as f6_esg2,
  e.macd_hist as f7_macd, f8_rsi, f9_pct_b, 0.0e0 as f10_volume_change
from m_feat f left join m_esgunit u on f.symbol = u.symbol
     left join m_ema e on f.symbol = e.symbol and f.date = e.date
""")


def _r(cols, prefix=""):
    return ", ".join(f"round({prefix}{c}, 6) as {c}" for c in cols)


@register("f4_f7_rolling_indicators", """
select symbol, date, round(f8_rsi, 6) as rsi, round(f9_pct_b, 6) as pct_b,
       round(f3_vol20, 6) as vol20, round(f4_dd60, 6) as dd60
from m_feat""")
def f4_f7_rolling_indicators(t):
    """RSI/100, Bollinger %B, 20-day volatility, 60-day drawdown."""
    p = FE.feature_panel(t.prices(), t.esg(), with_macd=False)
    return p.select("symbol", "date", F.col("f8_rsi").alias("rsi"), F.col("f9_pct_b").alias("pct_b"),
                    F.col("f3_vol20").alias("vol20"), F.col("f4_dd60").alias("dd60"))


@register("f5_f6_ema_macd", """
select symbol, date, round(ema_fast, 6) as ema_fast, round(ema_slow, 6) as ema_slow,
  round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, round(macd_hist, 6) as macd_hist
from m_ema""")
def f5_f6_ema_macd(t):
    """EMA12, EMA26, MACD line, signal and histogram (recurrence)."""
    return FE.ema_macd(t.prices())


@register("f9_feature_panel", f"select symbol, date, round(close, 6) as close, {_r(_FEATS)} from m_panel")
def f9_feature_panel(t):
    """the 11-feature panel on each symbol's own trading dates."""
    return FE.feature_panel(t.prices(), t.esg())


@register("f10_trimmed_panel", f"""
with firstok as (
  select min(date) as d from (
    select date, count(*) filter (where {' and '.join(f'{c} is not null' for c in _FEATS)}) as k
    from m_panel group by date) x
  where k = (select count(distinct symbol) from m_panel))
select symbol, date, round(close, 6) as close, {', '.join(f'round(coalesce({c}, 0), 6) as {c}' for c in _FEATS)}
from m_panel
where date >= coalesce((select d from firstok), (select min(date) from m_panel))""")
def f10_trimmed_panel(t):
    """panel from the first fully complete date on, NULL → 0. The panel
    is the stored feature table (a reliable checkpoint), read once by the
    trim and by its completeness subqueries."""
    from verdant.session import checkpoint_dir
    checkpoint_dir(t.spark)
    panel = FE.feature_panel(t.prices(), t.esg()).checkpoint(eager=True)
    return FE.trim_warmup(panel)


# The panel on one calendar: closes by day, and by month for symbols that trade
# in every month. In a gap returns look at the last known close; EMAs decay.
def _common_ctes(name: str, closes: str) -> None:
    """CTEs of the common-calendar panel of the closes in ``closes``: m_<name>."""
    days = "rows between {} preceding and current row"
    w = lambda n: f"(partition by symbol order by date {days.format(n - 1)})"
    cte(f"m_{name}_grid", f"""
select s.symbol, d.date, d.pos, p.close,
  last_value(p.close ignore nulls) over (partition by s.symbol order by d.date rows between unbounded preceding and current row) as known
from (select distinct symbol from {closes} where close is not null) s
cross join (select date, row_number() over (order by date) - 1 as pos from (select distinct date from {closes} where close is not null) x) d
left join {closes} p on p.symbol = s.symbol and p.date = d.date""")
    cte(f"m_{name}_step", f"""
select *, known / lag(known, 1) over v - 1 as ret,
  case when close - lag(close) over v > 0 then close - lag(close) over v else 0.0e0 end as gain,
  -(case when close - lag(close) over v < 0 then close - lag(close) over v else 0.0e0 end) as loss,
  pos - max(case when close is not null then pos end) over (partition by symbol order by date
            rows between unbounded preceding and 1 preceding) as gap
from m_{name}_grid window v as (partition by symbol order by date)""")
    fast, slow, sig = "2.0e0/13.0e0", "2.0e0/27.0e0", "2.0e0/10.0e0"
    mixed = lambda a, y: (f"case when g.close is null then {y} else (pow(1 - {a}, g.gap) * {y} + {a} * g.close) "  # noqa: E731
                          f"/ (pow(1 - {a}, g.gap) + {a}) end")
    cte(f"m_{name}_ema", f"""
select * from (
  with recursive walk(symbol, pos, e12, e26, sig) as (
    select symbol, pos, close, close, 0.0e0 from m_{name}_step where close is not null and gap is null
    union all
    select n.symbol, n.pos, n.e12, n.e26, {sig} * (n.e12 - n.e26) + (1 - {sig}) * n.sig from (
      select g.symbol, g.pos, {mixed(fast, 'w.e12')} as e12, {mixed(slow, 'w.e26')} as e26, w.sig
      from walk w join m_{name}_step g on g.symbol = w.symbol and g.pos = w.pos + 1) n)
  select symbol, pos, (e12 - e26) - sig as macd_hist from walk) q""")
    cte(f"m_{name}_panel", f"""
select s.symbol, s.date, s.close, s.ret as f0_return,
  s.known / lag(s.known, 20) over (partition by s.symbol order by s.date) - 1 as f1_mom20,
  s.known / lag(s.known, 60) over (partition by s.symbol order by s.date) - 1 as f2_mom60,
  case when s.n_ret >= 20 then s.sd_ret end as f3_vol20,
  case when s.n60 >= 60 then s.close / s.max60 - 1 end as f4_dd60,
  coalesce(u.esg_unit, 0.5e0) as f5_esg1, coalesce(u.esg_unit, 0.5e0) as f6_esg2, e.macd_hist as f7_macd,
  coalesce(100 - 100 / (1 + (case when s.pos >= 13 then s.gain14 end) / nullif(case when s.pos >= 13 then s.loss14 end, 0)), 50.0e0)
    / 100.0e0 as f8_rsi,
  case when s.n20 >= 20 then coalesce((s.close - (s.sma - 2 * s.sd)) / nullif((s.sma + 2 * s.sd) - (s.sma - 2 * s.sd), 0), 0.5e0)
    else 0.5e0 end as f9_pct_b, 0.0e0 as f10_volume_change
from (select *, count(ret) over {w(20)} as n_ret, stddev_samp(ret) over {w(20)} as sd_ret, count(close) over {w(60)} as n60,
        max(close) over {w(60)} as max60, avg(gain) over {w(14)} as gain14, avg(loss) over {w(14)} as loss14,
        count(close) over {w(20)} as n20, avg(close) over {w(20)} as sma, stddev_samp(close) over {w(20)} as sd
      from m_{name}_step) s
left join m_esgunit u on s.symbol = u.symbol left join m_{name}_ema e on e.symbol = s.symbol and e.pos = s.pos""")


cte("m_monthly_all", """
select symbol, cast(date_trunc('month', date) as date) as date, max_by(close, date) as close
from m_prices where close is not null group by 1, 2""")
cte("m_monthly", """
select * from m_monthly_all where symbol in (select symbol from m_monthly_all group by symbol
  having count(*) = (select count(distinct date) from m_monthly_all))""")
_common_ctes("daily", "m_prices")
_common_ctes("months", "m_monthly")
_common_ctes("allmonths", "m_monthly_all")


def _monthly(t):
    """The last close of every symbol and month."""
    return (t.prices().where(F.col("close").isNotNull())
            .groupBy("symbol", F.trunc("date", "month").alias("date")).agg(F.max_by("close", "date").alias("close")))


@register("f9_common_calendar", f"select symbol, date, round(close, 6) as close, {_r(_FEATS)} from m_daily_panel")
def f9_common_calendar(t):
    """F9 on the common calendar: every symbol on every trading date, gaps and all."""
    return FE.feature_panel(t.prices(), t.esg(), calendar="common", n_rows=t.price_rows())


@register("f9_common_monthly", f"select symbol, date, round(close, 6) as close, {_r(_FEATS)} from m_allmonths_panel")
def f9_common_monthly(t):
    """F9 on the calendar of months: few gaps, so that every rolling feature is met."""
    return FE.feature_panel(_monthly(t), t.esg(), calendar="common", n_rows=t.price_rows())


@register("f10_common_trim", f"""
with firstok as (
  select min(date) as d from (
    select date, count(*) filter (where {' and '.join(f'{c} is not null' for c in _FEATS)}) as k
    from m_months_panel group by date) x
  where k = (select count(distinct symbol) from m_months_panel))
select symbol, date, round(close, 6) as close, {', '.join(f'round(coalesce({c}, 0), 6) as {c}' for c in _FEATS)}
from m_months_panel
where date >= coalesce((select d from firstok), (select min(date) from m_months_panel))""")
def f10_common_trim(t):
    """F11 + F9 + F10: monthly closes of the symbols that cover the calendar,
    trimmed to the first month on which every symbol has every feature (the
    five years before it go)."""
    months = _monthly(t)
    full = months.join(FE.coverage(months, 1.0).select("symbol"), "symbol", "left_semi")
    panel = FE.feature_panel(full, t.esg(), calendar="common").checkpoint(eager=True)
    return FE.trim_warmup(panel)


@register("d6_cross_section", "select date, " + ", ".join(
    f"round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_std, round(max({c}), 6) as {c}_max"
    for c in ["f0_return", "f3_vol20", "f8_rsi", "f9_pct_b"]) + " from m_panel group by date")
def d6_cross_section(t):
    """Per-date mean / std / max of features over assets."""
    return FE.cross_section(FE.feature_panel(t.prices(), t.esg(), with_macd=False),
                            ["f0_return", "f3_vol20", "f8_rsi", "f9_pct_b"])


@register("d5_esg_unit_score", """
select c.symbol, round(coalesce(u.esg_unit, 0.5), 6) as esg_unit
from m_companies c left join m_esgunit u on c.symbol = u.symbol""")
def d5_esg_unit_score(t):
    """Normalised ESG input per company, 0.5 when it has no scores."""
    c = t.companies().select("symbol")
    return c.join(FE.esg_unit_score(t.esg()), "symbol", "left").select(
        "symbol", F.coalesce(F.col("esg_unit"), F.lit(0.5)).alias("esg_unit"))


@register("f11_coverage", """
select symbol, count(close) as n_dates from m_prices group by symbol
having count(close) >= floor((select count(distinct date) from m_prices) * 0.2)""")
def f11_coverage(t):
    """symbols with closes on at least 20 % of the calendar's dates."""
    return FE.coverage(t.prices(), 0.2)


@register("f12_sector_index", """
select c.*, coalesce(s.sector_id, 0) as sector_id
from m_companies c left join (
  select sector, dense_rank() over (order by sector) as sector_id
  from (select distinct sector from m_companies where sector is not null) d) s
  on c.sector is not distinct from s.sector""")
def f12_sector_index(t):
    """integer sector ordinal (NULL sector → 0)."""
    return FE.sector_index(t.companies())


@register("f13_time_split", """
with cal as (select date, row_number() over (order by date) as pos from (select distinct date from m_prices) d)
select split, count(*) as n_rows, min(p.date) as first_date, max(p.date) as last_date
from m_prices p join (
  select date, case when pos <= floor((select count(*) from cal) * 0.7) then 'train' else 'test' end as split
  from cal) c on p.date = c.date
group by split""")
def f13_time_split(t):
    """chronological 70/30 split of the price table by distinct date."""
    s = FE.time_split(t.prices(), 0.7)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
                                  F.max("date").alias("last_date"))


# ------------------------------------------------------------------ H1–H8

cte("m_proj_in", """
select h.portfolio_id, h.symbol, c.sector, greatest(h.weight, 0.0e0) as w0
from m_holdings h join m_companies c on h.symbol = c.symbol
""")


def _projection_sql(src: str = "m_proj_in", key: str = "portfolio_id", rounds: int = 5) -> str:
    """Chained CTEs for H1 (one per step) — the oracle restatement."""
    steps = []
    prev = src
    col = "w0"

    def norm(name, frm, c):
        steps.append(f"""{name}a as (select *, case when sum({c}) over (partition by {key}) = 0 then 1.0e0
            else {c} end as {c}_z from {frm})""")
        steps.append(f"""{name} as (select * exclude ({c}_z), {c}_z / sum({c}_z) over (partition by {key}) as {name}_w
            from {name}a)""")
        return name, f"{name}_w"

    prev, col = norm("pn0", prev, col)
    for i in range(rounds):
        steps.append(f"""pc{i} as (select *, least({col}, 0.12) as pc{i}_w from {prev})""")
        steps.append(f"""ps{i} as (select *, case when sum(pc{i}_w) over (partition by {key}, sector) > 0.35
               and sum(pc{i}_w) over (partition by {key}, sector) > 0
               then pc{i}_w * (0.35 / sum(pc{i}_w) over (partition by {key}, sector)) else pc{i}_w end as ps{i}_w
            from pc{i})""")
        prev, col = norm(f"pn{i + 1}", f"ps{i}", f"ps{i}_w")
    steps.append(f"""proj as (select *, {col} as weight_final,
        greatest({col} - 0.12, 0.0e0) as cap_excess,
        greatest(sum({col}) over (partition by {key}, sector) - 0.35, 0.0e0) as sector_excess from {prev})""")
    return ",\n".join(steps)


@register("h1_projected_holdings", f"""
with {_projection_sql()}
select portfolio_id, symbol, sector, round(weight_final, 6) as weight,
       round(cap_excess, 6) as cap_excess, round(sector_excess, 6) as sector_excess
from proj""")
def h1_projected_holdings(t):
    """H1: every customer portfolio projected onto the 12 % / 35 % caps."""
    h = t.holdings().join(t.companies().select("symbol", "sector"), "symbol")
    return P.project_weights(h).select("portfolio_id", "symbol", "sector", "weight",
                                       "cap_excess", "sector_excess")


def _segment_requests(t):
    """Optimise requests derived from the customer table: one per market
    segment, its size from the segment's customer count (5–50 stocks), the
    segment's most common nation's region excluded for every other segment."""
    c = t.raw("customer")
    seg = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    ranked = seg.withColumn("request_id", F.dense_rank().over(Window.orderBy("c_mktsegment")).cast("bigint"))
    return ranked.select(
        "request_id",
        (F.col("n") % 46 + 5).cast("int").alias("max_stocks"),
        F.when(F.col("request_id") % 2 == 0, F.array(F.lit("ASIA"), F.lit("EUROPE")))
         .otherwise(F.array().cast("array<string>")).alias("excluded_sectors"),
        (F.col("n") * 100.0).alias("investment_amount"),
        F.when(F.col("request_id") % 3 == 0, F.lit("conservative")).otherwise(F.lit("balanced"))
         .alias("risk_tolerance"),
        F.lit("high").alias("esg_importance"),
    )


cte("m_requests", """
select request_id, cast(n % 46 + 5 as integer) as max_stocks,
  case when request_id % 2 = 0 then ['ASIA', 'EUROPE'] else [] end as excluded_sectors,
  n * 100.0e0 as investment_amount,
  case when request_id % 3 = 0 then 'conservative' else 'balanced' end as risk_tolerance,
  'high' as esg_importance
from (select c_mktsegment, count(*) as n, dense_rank() over (order by c_mktsegment) as request_id
      from customer group by c_mktsegment) s
""")

_SELECT_SQL = """
select r.request_id, m.symbol, c.name, c.sector, m.composite_score, m.avg_esg_composite, m.sharpe_252d,
       row_number() over (partition by r.request_id order by m.composite_score desc nulls last, m.symbol) as rank,
       r.investment_amount, least(greatest(r.max_stocks, 1), 50) as n
from m_requests r, m_metrics m join m_companies c on m.symbol = c.symbol
where (len(r.excluded_sectors) = 0 or (c.sector is not null and not list_contains(r.excluded_sectors, c.sector)))
  {extra}
"""

cte("m_sel_equal", f"select * from ({_SELECT_SQL.format(extra='')}) x where rank <= n")
cte("m_sel_elig", f"select * from ({_SELECT_SQL.format(extra='and m.eligible_hard_screen')}) x where rank <= n")


@register("h2_equal_weight", """
select request_id, symbol, rank, round(1.0e0 / count(*) over (partition by request_id), 6) as weight
from m_sel_equal""")
def h2_equal_weight(t):
    """H2: equal-weight top-N selection per optimise request."""
    sel = P.select_top(metrics_of(t), t.companies(), _segment_requests(t))
    return P.equal_weight(sel).select("request_id", "symbol", F.col("rank").cast("bigint"), "weight")


@register("h3_esg_weight", """
select request_id, symbol,
  round(case when sum(coalesce(avg_esg_composite, 0)) over (partition by request_id) > 0
    then coalesce(avg_esg_composite, 0) / sum(coalesce(avg_esg_composite, 0)) over (partition by request_id)
    else 1.0e0 / count(*) over (partition by request_id) end, 6) as weight
from m_sel_elig""")
def h3_esg_weight(t):
    """H3: ESG-proportional weights over the eligible selection."""
    sel = P.select_top(metrics_of(t), t.companies(), _segment_requests(t), eligible_only=True)
    return P.esg_weight(sel).select("request_id", "symbol", "weight")


cte("m_alloc_in", """
select request_id as portfolio_id, symbol, sector, name, sharpe_252d, avg_esg_composite, investment_amount,
  case when sum(coalesce(avg_esg_composite, 0)) over (partition by request_id) > 0
    then coalesce(avg_esg_composite, 0) / sum(coalesce(avg_esg_composite, 0)) over (partition by request_id)
    else 1.0e0 / count(*) over (partition by request_id) end as w0
from m_sel_elig where rank <= 30 and (investment_amount is null or investment_amount >= 0)
""")


@register("h4_allocations", f"""
with {_projection_sql('m_alloc_in')}
select portfolio_id as request_id, symbol, name, sector, round(weight_final, 4) as weight,
  printf('%.1f%%', round(weight_final * 100, 1)) as weight_pct,
  round(coalesce(sharpe_252d, 0), 6) as sharpe, round(coalesce(avg_esg_composite, 0), 6) as esg,
  case when investment_amount > 0 then round(weight_final * investment_amount, 2) end as amount
from proj""")
def h4_allocations(t):
    """H4: allocation rows per request (ESG weights, projected)."""
    return P.by_weight(P.allocate(metrics_of(t), t.companies(), _segment_requests(t), method="esg"))


@register("h4_allocation_totals", f"""
with {_projection_sql('m_alloc_in')},
a as (select portfolio_id as request_id, sector, round(weight_final, 4) as weight,
        coalesce(sharpe_252d, 0) as sharpe, coalesce(avg_esg_composite, 0) as esg from proj)
select a.request_id, round(sum(weight * sharpe), 3) as weighted_sharpe, round(sum(weight * esg), 1) as weighted_esg,
  count(*) as num_holdings, count(distinct sector) as sector_count,
  r.risk_tolerance, r.esg_importance, r.investment_amount
from a join m_requests r on a.request_id = r.request_id
group by a.request_id, r.risk_tolerance, r.esg_importance, r.investment_amount""")
def h4_allocation_totals(t):
    """H4: per-request totals and profile echoes."""
    req = _segment_requests(t)
    alloc = P.allocate(metrics_of(t), t.companies(), req, method="esg")
    return P.allocation_totals(alloc, req)


cte("m_analysis", """
select h.portfolio_id, h.symbol, c.name, c.sector, h.raw_weight, round(h.raw_weight, 4) as weight,
  coalesce(m.sharpe_252d, 0.0e0) as sharpe, coalesce(m.avg_esg_composite, 0.0e0) as esg,
  coalesce(m.annual_volatility, 0.0e0) as volatility, coalesce(m.max_drawdown, 0.0e0) as max_drawdown
from (select portfolio_id, symbol, weight / case when sum(weight) over (partition by portfolio_id) = 0 then 1.0e0
             else sum(weight) over (partition by portfolio_id) end as raw_weight
      from (select portfolio_id, upper(trim(symbol)) as symbol, sum(weight) as weight
            from m_holdings group by 1, 2) x) h
join m_metrics m on h.symbol = m.symbol join m_companies c on h.symbol = c.symbol
""")

cte("m_ptotals", """
select portfolio_id, round(sum(weight * sharpe), 3) as weighted_sharpe, round(sum(weight * esg), 1) as weighted_esg,
  round(sum(weight * volatility), 4) as weighted_volatility, count(*) as num_holdings,
  count(distinct sector) as sector_count, least(count(distinct sector) / 5.0e0, 1.0e0) as diversification_score,
  sum(weight * esg) as raw_weighted_esg
from m_analysis group by portfolio_id
""")


@register("h5_portfolio_analysis", """
select portfolio_id, symbol, name, sector, round(raw_weight, 6) as raw_weight, round(weight, 6) as weight,
  round(sharpe, 6) as sharpe, round(esg, 6) as esg, round(volatility, 6) as volatility,
  round(max_drawdown, 6) as max_drawdown from m_analysis""")
def h5_portfolio_analysis(t):
    """H5: per-holding analysis of every customer portfolio."""
    return P.analyze(t.holdings(), metrics_of(t), t.companies())


@register("d3_h7_portfolio_totals", """
select portfolio_id, round(weighted_sharpe, 6) as weighted_sharpe, round(weighted_esg, 6) as weighted_esg,
  round(weighted_volatility, 6) as weighted_volatility, num_holdings, sector_count,
  round(diversification_score, 6) as diversification_score
from m_ptotals""")
def d3_h7_portfolio_totals(t):
    """D3 + H7: weighted measures, holdings, sectors, diversification."""
    return P.portfolio_totals(P.analyze(t.holdings(), metrics_of(t), t.companies())).drop("raw_weighted_esg")


@register("d4_sector_exposure", """
select portfolio_id, sector, round(sum(raw_weight), 6) as sector_weight
from m_analysis where sector is not null group by portfolio_id, sector""")
def d4_sector_exposure(t):
    """Σ weight by portfolio and sector."""
    return P.sector_exposure(P.analyze(t.holdings(), metrics_of(t), t.companies()))


@register("h6_portfolio_warnings", """
select portfolio_id, 'position' as rule,
  symbol || ' weight (' || cast(cast(round(weight * 100, 0) as bigint) as varchar) || '%) exceeds 12% limit' as message
from m_analysis where weight > 0.12
union all
select portfolio_id, 'sector' as rule,
  sector || ' sector (' || cast(cast(round(sw * 100, 0) as bigint) as varchar) || '%) exceeds 35% limit'
from (select portfolio_id, sector, sum(raw_weight) as sw from m_analysis where sector is not null
      group by 1, 2) s where sw > 0.35
union all
select portfolio_id, 'diversification', 'Low diversification: only ' || cast(sector_count as varchar) || ' sector(s)'
from m_ptotals where sector_count < 3
union all
select portfolio_id, 'esg', 'Low portfolio ESG score (' || printf('%.1f', round(raw_weighted_esg, 1)) || ')'
from m_ptotals where raw_weighted_esg < 30""")
def h6_portfolio_warnings(t):
    """H6: rule hits with messages for every customer portfolio."""
    return P.portfolio_warnings(P.analyze(t.holdings(), metrics_of(t), t.companies()), t.price_rows())


@register("h8_softmax_weights", """
select portfolio_id, date, symbol, round(z / sum(z) over (partition by portfolio_id, date), 6) as weight
from (select *, exp(f8_rsi - max(f8_rsi) over (partition by portfolio_id, date)) as z
      from (select w.portfolio_id, w.date, w.symbol, f.f8_rsi
            from m_rebalance w join m_feat f on w.symbol = f.symbol and w.date = f.date) x) y""")
def h8_softmax_weights(t):
    """H8: softmax over each rebalance's symbols of their RSI feature."""
    panel = FE.feature_panel(t.prices(), t.esg(), with_macd=False).select(
        "symbol", "date", F.col("f8_rsi").alias("score"))
    s = t.rebalance().join(panel, ["symbol", "date"])
    return P.softmax_weights(s).select("portfolio_id", "date", "symbol", "weight")


# ------------------------------------------------------------------ H9–H16

cte("m_ret", "select symbol, date, ret from m_path where ret is not null")

cte("m_preturn", """
select w.portfolio_id, w.date, sum(w.weight * coalesce(r.ret, 0.0e0)) as port_return
from m_rebalance w
join (select d.date, (select min(t.date) from m_ret t where t.date > d.date) as next_date
      from (select distinct date from m_rebalance) d) cal
  on w.date = cal.date
left join m_ret r on r.symbol = w.symbol and r.date = cal.next_date
where cal.next_date is not null
group by w.portfolio_id, w.date
""")

cte("m_turnover", """
with d as (select portfolio_id, date, lag(date) over (partition by portfolio_id order by date) as prev_date,
                  lead(date) over (partition by portfolio_id order by date) as next_date
           from (select distinct portfolio_id, date from m_rebalance) x),
cur as (select w.portfolio_id, w.symbol, w.date, d.prev_date, w.weight as w_cur
        from m_rebalance w join d on w.portfolio_id = d.portfolio_id and w.date = d.date),
prv as (select w.portfolio_id, w.symbol, d.next_date as date, w.weight as w_prev
        from m_rebalance w join d on w.portfolio_id = d.portfolio_id and w.date = d.date
        where d.next_date is not null),
pairs as (select coalesce(c.portfolio_id, p.portfolio_id) as portfolio_id, coalesce(c.date, p.date) as date,
                 coalesce(c.w_cur, 0.0e0) as wc, coalesce(p.w_prev, 0.0e0) as wp
          from (select * from cur where prev_date is not null) c
          full outer join prv p on c.portfolio_id = p.portfolio_id and c.symbol = p.symbol and c.date = p.date),
na as (select portfolio_id, count(distinct symbol) as n from m_rebalance group by portfolio_id)
select portfolio_id, date, sum(abs(wc - wp)) as turnover from pairs group by 1, 2
union all
select c.portfolio_id, c.date, sum(abs(c.w_cur - 1.0e0 / na.n)) + (max(na.n) - count(*)) / max(na.n) as turnover
from cur c join na on c.portfolio_id = na.portfolio_id where c.prev_date is null group by 1, 2
""")

cte("m_ledger", """
with l0 as (
  select portfolio_id, date, port_return,
    product(1 + port_return) over (partition by portfolio_id order by date
      rows between unbounded preceding and current row) as value,
    case when count(*) over (partition by portfolio_id order by date
                rows between unbounded preceding and current row) > 1
      then stddev_pop(port_return) over (partition by portfolio_id order by date
                rows between 19 preceding and current row) else 0.0e0 end as rolling_vol,
    row_number() over (partition by portfolio_id order by date) as step
  from m_preturn),
l1 as (select *, greatest(1.0e0, max(value) over (partition by portfolio_id order by date
          rows between unbounded preceding and current row)) as peak,
          coalesce(lag(value) over (partition by portfolio_id order by date), 1.0e0) as prev_value from l0),
ex as (select w.portfolio_id, w.date, sum(w.weight * coalesce(u.esg_unit, 0.5e0)) as esg
       from m_rebalance w left join m_esgunit u on w.symbol = u.symbol group by 1, 2)
select l1.portfolio_id, l1.date, port_return, value, rolling_vol, step, peak,
  (value - peak) / peak as drawdown, prev_value, t.turnover, ex.esg
from l1 left join m_turnover t on l1.portfolio_id = t.portfolio_id and l1.date = t.date
        left join ex on l1.portfolio_id = ex.portfolio_id and l1.date = ex.date
""")


def _kept_weights(t):
    """The rebalance weights written once, where a query needs them twice."""
    path = scratch(t.spark, "weights")
    w = t.rebalance()
    w.write.parquet(path)
    return t.spark.read.schema(w.schema).parquet(path)


def _ledger(t, weights=None):
    returns = risk.return_path(t.prices()).where(F.col("ret").isNotNull()).select("symbol", "date", "ret")
    return B.backtest_ledger(t.rebalance() if weights is None else weights, returns, FE.esg_unit_score(t.esg()), t.price_rows())


_LEDGER_D = ["port_return", "value", "rolling_vol", "peak", "drawdown", "prev_value", "turnover", "esg"]


@register("h9_portfolio_returns", """
select portfolio_id, date, round(port_return, 6) as port_return from m_preturn""")
def h9_portfolio_returns(t):
    """Weights of each rebalance × next trading day's returns."""
    returns = risk.return_path(t.prices()).where(F.col("ret").isNotNull()).select("symbol", "date", "ret")
    return B.portfolio_returns(t.rebalance(), returns, t.price_rows())


@register("h10_backtest_ledger", f"""
select portfolio_id, date, step, {_r(_LEDGER_D)} from m_ledger""")
def h10_backtest_ledger(t):
    """Value, peak, drawdown, turnover, rolling vol and ESG per step."""
    return _ledger(t).select("portfolio_id", "date", "step", *_LEDGER_D)


@register("h13_reward_columns", """
select portfolio_id, date,
  round(case when prev_value <= 0 then 0.0e0 else ln(value / prev_value) end, 6) as reward_return,
  round(-abs(drawdown), 6) as reward_drawdown,
  round(port_return - 0.05 * rolling_vol - 0.001 * turnover + 0.8 * esg
        - 0.1 * greatest(0.0e0, abs(drawdown) - 0.1), 6) as reward_combined
from m_ledger""")
def h13_reward_columns(t):
    """Per-step rewards with the 'high' ESG weight (λ = 0.8)."""
    r = B.reward_columns(_ledger(t), lam=P.ESG_LAMBDA["high"])
    return r.select("portfolio_id", "date", "reward_return", "reward_drawdown", "reward_combined")


_DSR_SQL_BODY = """s as (
  select portfolio_id, date, port_return as r, row_number() over (partition by portfolio_id order by date) as rn,
         count(*) over (partition by portfolio_id) as n
  from m_preturn),
d(portfolio_id, rn, date, r, a, b, dsr) as (
  select portfolio_id, rn, date, r, 0.0e0 + 0.01 * (r - 0.0e0), 1e-8 + 0.01 * (r * r - 1e-8),
         case when abs(pow(1e-8 - 0.0e0 * 0.0e0, 1.5)) < 1e-12 then 0.0e0
              else (1e-8 * r - 0.5 * 0.0e0 * r * r) / pow(1e-8 - 0.0e0 * 0.0e0, 1.5) end
  from s where rn = 1
  union all
  select s.portfolio_id, s.rn, s.date, s.r, d.a + 0.01 * (s.r - d.a), d.b + 0.01 * (s.r * s.r - d.b),
         case when d.b - d.a * d.a < 0 then null
              when abs(pow(d.b - d.a * d.a, 1.5)) < 1e-12 then 0.0e0
              else (d.b * s.r - 0.5 * d.a * s.r * s.r) / pow(d.b - d.a * d.a, 1.5) end
  from d join s on s.portfolio_id = d.portfolio_id and s.rn = d.rn + 1)"""


@register("h14_h15_recurrences", f"""
select * from (
with recursive {_DSR_SQL_BODY},
g(portfolio_id, rn, date, gval) as (
  select portfolio_id, rn, date, r from s where rn = n
  union all
  select s.portfolio_id, s.rn, s.date, s.r + 0.99 * g.gval
  from g join s on s.portfolio_id = g.portfolio_id and s.rn = g.rn - 1)
select d.portfolio_id, d.date, round(d.dsr, 6) as dsr, round(g.gval, 6) as return_to_go,
  round(case when count(*) over (partition by g.portfolio_id) > 1
              and stddev_samp(g.gval) over (partition by g.portfolio_id) > 0
    then (g.gval - avg(g.gval) over (partition by g.portfolio_id))
         / (stddev_samp(g.gval) over (partition by g.portfolio_id) + 1e-8)
    else g.gval end, 6) as return_to_go_z
from d join g on d.portfolio_id = g.portfolio_id and d.rn = g.rn) q""")
def h14_h15_recurrences(t):
    """H14 + H15: differential Sharpe and discounted return-to-go per step."""
    returns = risk.return_path(t.prices()).where(F.col("ret").isNotNull()).select("symbol", "date", "ret")
    pr = B.portfolio_returns(t.rebalance(), returns, t.price_rows())
    return B.differential_sharpe(pr)


@register("h11_backtest_summary", f"""
with l as (select *, max(value) over (partition by portfolio_id order by date
             rows between unbounded preceding and current row) as cpeak from m_ledger),
perf as (
  select portfolio_id, arg_max(value, date) - 1 as total_return,
    case when count(port_return) = 0 then 0.0e0 when product(1 + port_return) - 1 <= -1 then 0.0e0
         else pow(1 + (product(1 + port_return) - 1), 252.0e0 / count(port_return)) - 1 end as annual_return,
    case when count(port_return) = 0 then 0.0e0 else stddev_samp(port_return) * sqrt(252) end as annual_volatility,
    case when stddev_samp(port_return) = 0 then 0.0e0
         else avg(port_return) / stddev_samp(port_return) * sqrt(252) end as sharpe,
    case when count(case when port_return < 0 then port_return end) = 0 then 0.0e0
         when stddev_samp(case when port_return < 0 then port_return end) = 0 then 0.0e0
         else avg(port_return) / stddev_samp(case when port_return < 0 then port_return end) * sqrt(252) end as sortino,
    coalesce(min((value - cpeak) / cpeak), 0.0e0) as max_drawdown,
    count(*) as days
  from l group by portfolio_id),
mw as (select w.portfolio_id, w.symbol, sum(w.weight) / max(p.days) as mean_weight
       from m_rebalance w join perf p on w.portfolio_id = p.portfolio_id
       where exists (select 1 from m_ledger l where l.portfolio_id = w.portfolio_id and l.date = w.date)
       group by 1, 2),
hold as (select mw.portfolio_id, sum(mean_weight * coalesce(u.esg_unit, 0.5e0)) as avg_esg,
           count(*) filter (where mean_weight > 0.01) as num_holdings, max(mean_weight) as max_position
         from mw left join m_esgunit u on mw.symbol = u.symbol group by 1)
select p.portfolio_id, round(total_return, 6) as total_return, {sig_sql('annual_return', 'annual_return')},
  round(annual_volatility, 6) as annual_volatility, round(sharpe, 6) as sharpe, round(sortino, 6) as sortino,
  round(max_drawdown, 6) as max_drawdown, days, round(avg_esg, 6) as avg_esg, num_holdings,
  round(max_position, 6) as max_position
from perf p left join hold h on p.portfolio_id = h.portfolio_id""", sig=("annual_return",))
def h11_backtest_summary(t):
    """Back-test summary per portfolio."""
    w = _kept_weights(t)
    return B.backtest_summary(_ledger(t, w), w)


@register("h12_equal_weight_benchmark", f"""
with d as (select date, sum(ret) / (select count(distinct symbol) from m_ret) as ew_return from m_ret group by date)
select date, round(ew_return, 6) as ew_return,
  {sig_sql('product(1 + ew_return) over (order by date rows between unbounded preceding and current row)', 'ew_value')}
from d""", sig=("ew_value",))
def h12_equal_weight_benchmark(t):
    """Equal-weight benchmark over all symbols, compounded."""
    returns = risk.return_path(t.prices()).where(F.col("ret").isNotNull()).select("symbol", "date", "ret")
    return B.benchmark(returns)


@register("h16_model_registry", """
with reg as (
  select portfolio_id as model_id, sharpe, case when portfolio_id % 7 = 0 then 'active' else 'trained' end as status
  from (select portfolio_id, case when stddev_samp(port_return) = 0 then 0.0e0
          else avg(port_return) / stddev_samp(port_return) * sqrt(252) end as sharpe
        from m_ledger group by portfolio_id) s),
best as (select model_id as id from reg where sharpe is not null order by sharpe desc, model_id limit 1)
select model_id, round(sharpe, 6) as sharpe,
  case when model_id = (select id from best) then 'active' when status = 'active' then 'retired' else status end as status
from reg""")
def h16_model_registry(t):
    """Back-tested portfolios as a model registry (every 7th marked
    active); activating the best-Sharpe one retires the others."""
    w = _kept_weights(t)
    s = B.backtest_summary(_ledger(t, w), w)
    reg = s.select(F.col("portfolio_id").alias("model_id"), "sharpe",
                   F.when(F.col("portfolio_id") % 7 == 0, F.lit("active")).otherwise(F.lit("trained"))
                    .alias("status"))
    best = reg.where(F.col("sharpe").isNotNull()).select(
        F.max_by("model_id", F.struct("sharpe", -F.col("model_id")))).scalar()
    return B.activate(reg, best)
