"""DuckDB oracle SQL for the registered queries.

Each query's SQL is an independent re-statement of the operator semantics over
the raw parquet views; the model tables are the CTEs of FIXTURES.md §3. CTEs are
collected by name with their dependencies so every statement is self-contained.
"""

from __future__ import annotations

import re

SYM = "concat('S', lpad(cast({k} as varchar), 6, '0'))"

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


cte("m_companies", f"""
select {SYM.format(k='s_suppkey')} as symbol, s_name as name,
       case when s_suppkey % 29 = 7 then null else r_name end as sector,
       n_name as sub_industry,
       (s_suppkey % 17 = 3) as restricted_business,
       (s_suppkey % 23 = 5) as severe_controversy
from supplier join nation on s_nationkey = n_nationkey
              join region on n_regionkey = r_regionkey
""")

cte("m_prices", f"""
select {SYM.format(k='l_suppkey')} as symbol, cast(l_shipdate as date) as date,
       100 + cast(min(cast(l_extendedprice as decimal(15,2))) as double)/1000 as low,
       100 + cast(max(cast(l_extendedprice as decimal(15,2))) as double)/1000 as high,
       100 + cast(sum(cast(l_extendedprice as decimal(15,2))) as double)/count(*)/1000 as close,
       cast(sum(l_quantity) as bigint) as volume
from lineitem group by 1, 2
""")

cte("m_esg", f"""
select {SYM.format(k='l_suppkey')} as symbol,
       make_date(cast(year(l_shipdate) as int), 12, 31) as date,
       l_returnflag as provider,
       cast(sum(cast(l_discount as decimal(6,2))) as double)/count(*)*1000 as e_score,
       cast(sum(cast(l_tax as decimal(6,2))) as double)/count(*)*1250 as s_score,
       cast(sum(cast(l_quantity as decimal(6,0))) as double)/count(*)*2 as g_score,
       greatest(0.0e0, max(s_acctbal))/100 as composite_score
from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3
""")

cte("m_holdings", f"""
select o_custkey as portfolio_id, {SYM.format(k='l_suppkey')} as symbol,
       cast(sum(cast(l_extendedprice as decimal(15,2))) as double) as weight
from orders join lineitem on o_orderkey = l_orderkey group by 1, 2
""")

cte("m_rebalance", f"""
select portfolio_id, date, symbol,
       cast(v as double) / cast(sum(v) over (partition by portfolio_id, date) as double) as weight
from (select o_custkey as portfolio_id, cast(o_orderdate as date) as date,
             {SYM.format(k='l_suppkey')} as symbol,
             sum(cast(l_extendedprice as decimal(15,2))) as v
      from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3) x
""")

# ---- E1–E10, D1, G1–G3 -------------------------------------------------
cte("m_path1", """
select symbol, date, close,
       row_number() over w as rn,
       count(*) over (partition by symbol) as n,
       close / lag(close) over w - 1 as ret,
       max(close) over (w rows between unbounded preceding and current row) as peak
from m_prices where close is not null
window w as (partition by symbol order by date)
""")

cte("m_path", """
select *, max(case when rn >= 2 then close end) over
          (partition by symbol order by date rows between unbounded preceding and current row) as peak2
from m_path1
""")

_LAST = "max(case when rn = n then close end)"
_FIRST = "max(case when rn = 1 then close end)"
_DOWN = "(case when ret < 0 then ret end)"
_ANN = (f"case when count(*) - 1 <= 0 then 0.0e0 when {_LAST}/{_FIRST} - 1 <= -1 then 0.0e0 "
        f"else pow(1 + ({_LAST}/{_FIRST} - 1), 252.0e0/(count(*) - 1)) - 1 end")
_MDDR = "coalesce(min((close - peak2)/peak2), 0.0e0)"


def _mom(k: int) -> str:
    back = f"max(case when rn = n - {k} then close end)"
    return f"case when count(*) < {k + 1} then 0.0e0 else ({_LAST} - {back})/{back} end"


cte("m_symagg", f"""
select symbol, count(*) as n_closes, count(ret) as n_returns,
  {_ANN} as annual_return,
  case when count(ret) = 0 then 0.0e0 else stddev_samp(ret)*sqrt(252) end as annual_volatility,
  case when stddev_samp(ret) = 0 then 0.0e0 else avg(ret)/stddev_samp(ret)*sqrt(252) end as sharpe_252d,
  case when count{_DOWN} = 0 then 0.0e0 when stddev_samp{_DOWN} = 0 then 0.0e0
       else avg(ret)/stddev_samp{_DOWN}*sqrt(252) end as sortino_252d,
  case when {_MDDR} = 0 then 0.0e0 else ({_ANN})/abs({_MDDR}) end as calmar_ratio,
  coalesce(min((close - peak)/peak), 0.0e0) as max_drawdown,
  {_mom(20)} as momentum_20d,
  {_mom(60)} as momentum_60d
from m_path group by symbol
""")

_METRICS = ["annual_return", "annual_volatility", "sharpe_252d", "sortino_252d",
            "calmar_ratio", "max_drawdown", "momentum_20d", "momentum_60d"]

cte("m_esgavg", """
select symbol, avg(composite_score) as avg_esg_composite, avg(e_score) as avg_e_score,
       avg(s_score) as avg_s_score, avg(g_score) as avg_g_score
from m_esg group by symbol
""")

cte("m_metrics0", f"""
select a.symbol, a.n_closes, a.n_returns,
  {', '.join(f'case when a.n_returns >= 20 then a.{c} end as {c}' for c in _METRICS)},
  e.avg_esg_composite, e.avg_e_score, e.avg_s_score, e.avg_g_score,
  c.sector, c.restricted_business, c.severe_controversy,
  (select max(date) from m_prices) as as_of_date
from m_symagg a join m_companies c on a.symbol = c.symbol
     left join m_esgavg e on a.symbol = e.symbol
where a.n_closes >= 60
""")

cte("m_metrics1", """
select *,
  0.4 * sharpe_252d + 0.4 * (avg_esg_composite / 100) + 0.2 * (1 - annual_volatility) as composite_score,
  coalesce(not restricted_business and not severe_controversy and avg_esg_composite >= 20, false)
     as eligible_hard_screen
from m_metrics0
""")

cte("m_metrics", f"""
select symbol, as_of_date, {', '.join(_METRICS)},
  avg_esg_composite, avg_e_score, avg_s_score, avg_g_score, composite_score, eligible_hard_screen,
  case when sector is null or composite_score is null then null else
    (rank() over (partition by sector order by composite_score asc nulls last)
     + (count(*) over (partition by sector, composite_score) - 1) / 2.0e0)
    / count(composite_score) over (partition by sector) end as sector_rank_pct,
  n_closes, n_returns
from m_metrics1
""")

cte("m_sectors", """
select c.sector, max(m.as_of_date) as as_of_date, count(*) as company_count,
  coalesce(avg(m.sharpe_252d), 0.0e0) as avg_sharpe,
  coalesce(avg(m.avg_esg_composite), 0.0e0) as avg_esg,
  coalesce(avg(m.annual_volatility), 0.0e0) as avg_volatility,
  coalesce(avg(m.annual_return), 0.0e0) as avg_return
from m_metrics m join m_companies c on m.symbol = c.symbol
where c.sector is not null group by c.sector
""")

cte("m_sector_rankings", """
select *, 0.4 * avg_sharpe + 0.4 * (avg_esg / 100) + 0.2 * (1 - avg_volatility) as composite_score
from m_sectors
""")


def _deps(sql: str) -> list[str]:
    """CTE names referenced by ``sql`` in dependency order."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_ctes(body: str) -> str:
    names = _deps(body)
    body = body.strip()
    if not names:
        return body
    parts = ",\n".join(f"{n} as (\n{CTES[n]}\n)" for n in names)
    m = re.match(r"(?i)with(\s+recursive)?\s", body)
    if m:
        return f"with{m.group(1) or ''} {parts},\n{body[m.end():]}"
    return f"with {parts}\n{body}"


def r6(expr: str, alias: str | None = None) -> str:
    """Round a double to 6 dp, as the Spark side does before comparing."""
    alias = alias or expr.split(".")[-1]
    return f"round({expr}, 6) as {alias}"
