"""Portfolio construction and analysis for many portfolios at once
(D3, D4, H1–H8).

Portfolio-keyed work partitions by ``portfolio_id`` once; windows on
(portfolio_id, sector) reuse that partitioning (a clustered distribution on a
subset of the keys), so the constraint projection's unrolled rounds add no
exchange. A portfolio holds at most the listed universe, so its group is small;
many portfolios spread across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.functions.numeric import fixed_round
from verdant.operators.query import latest
from verdant.sources.tables import dealt

# Fixed values of the portfolio rules.
MAX_WEIGHT = 0.12
SECTOR_CAP = 0.35
PROJECTION_ROUNDS = 5
SELECT_MAX = 50
LOW_DIVERSIFICATION_SECTORS = 3
LOW_ESG = 30.0
DIVERSIFIED_SECTORS = 5
ESG_LAMBDA = {"low": 0.2, "medium": 0.5, "high": 0.8}
NULL_SECTOR_KEY = "\u0000"


# ------------------------------------------------------------- H1 projection

def project_weights(w: DataFrame, max_weight: float = MAX_WEIGHT, sector_cap: float = SECTOR_CAP,
                    rounds: int = PROJECTION_ROUNDS, key: str = "portfolio_id",
                    weight: str = "weight") -> DataFrame:
    """H1: clip at 0; all-zero → equal; normalise; then ``rounds`` times:
    cap each position, scale sectors above the cap, re-normalise.

    The final re-normalisation can push weights back above the caps (when a
    portfolio is too small to satisfy them); ``cap_excess`` and
    ``sector_excess`` report the residual violation per row. Sector groups are
    sector names, NULL being its own group."""
    wp = Window.partitionBy(key)
    ws = Window.partitionBy(key, "sector")
    x = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    df = w.withColumn("_w", x)

    def normalise(d: DataFrame) -> DataFrame:
        total = F.sum("_w").over(wp)
        d = d.withColumn("_w", F.when(total == 0, F.lit(1.0)).otherwise(F.col("_w")))
        return d.withColumn("_w", F.col("_w") / F.sum("_w").over(wp))

    df = normalise(df)
    for _ in range(rounds):
        df = df.withColumn("_w", F.least(F.col("_w"), F.lit(max_weight)))
        ssum = F.sum("_w").over(ws)
        df = df.withColumn("_w", F.when((ssum > sector_cap) & (ssum > 0),
                                        F.col("_w") * (F.lit(sector_cap) / ssum))
                                  .otherwise(F.col("_w")))
        df = normalise(df)
    sector_total = F.sum("_w").over(ws)
    return (df.withColumn(weight, F.col("_w"))
              .withColumn("cap_excess", F.greatest(F.col("_w") - max_weight, F.lit(0.0)))
              .withColumn("sector_excess", F.greatest(sector_total - sector_cap, F.lit(0.0)))
              .drop("_w"))


# ----------------------------------------------------------- H2, H3, H8

def _requests(requests: DataFrame) -> DataFrame:
    cols = requests.columns
    r = requests
    if "excluded_sectors" not in cols:
        r = r.withColumn("excluded_sectors", F.lit(None).cast("array<string>"))
    if "max_stocks" not in cols:
        r = r.withColumn("max_stocks", F.lit(15))
    return r.withColumn("_n", F.least(F.greatest(F.col("max_stocks").cast("int"), F.lit(1)),
                                      F.lit(SELECT_MAX)))


def select_top(metrics: DataFrame, companies: DataFrame, requests: DataFrame,
               eligible_only: bool = False) -> DataFrame:
    """Top ``max_stocks`` (1–50) companies by composite per request, excluded
    sectors removed (NOT IN semantics: with a non-empty list, NULL-sector
    companies go too).

    No request × company product is formed: at most 50 companies per sector
    can ever be picked, so candidates are the top 50 of each sector (a
    WindowGroupLimit), and each request is expanded to the sectors it keeps
    (the sector list is a bounded scalar subquery) and equi-joined to them."""
    m = latest(metrics, "symbol").join(
        companies.select("symbol", "name", "sector"), "symbol")
    if eligible_only:
        m = m.where(F.col("eligible_hard_screen"))
    m = m.withColumn("_sector_key", F.coalesce(F.col("sector"), F.lit(NULL_SECTOR_KEY)))
    order = [F.desc_nulls_last("composite_score"), F.asc("symbol")]
    cand = (m.withColumn("_r", F.row_number().over(Window.partitionBy("_sector_key").orderBy(*order)))
             .where(F.col("_r") <= SELECT_MAX).drop("_r"))
    keys = cand.select(F.collect_set("_sector_key")).scalar()
    r = _requests(requests).withColumn("_sector_key", F.explode(keys))
    ex = F.coalesce(F.col("excluded_sectors"), F.array().cast("array<string>"))
    keep = F.when(F.size(ex) == 0, F.lit(True)).otherwise(
        (F.col("_sector_key") != NULL_SECTOR_KEY) & ~F.array_contains(ex, F.col("_sector_key")))
    r = r.where(keep)
    j = r.join(cand, "_sector_key")
    wr = Window.partitionBy("request_id").orderBy(*order)
    j = j.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= F.col("_n"))
    return j.drop("_sector_key", "_n")


def equal_weight(selection: DataFrame) -> DataFrame:
    """H2: w = 1/n within each request."""
    return selection.withColumn(
        "weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("request_id")))


def esg_weight(selection: DataFrame, esg: str = "avg_esg_composite") -> DataFrame:
    """H3: w = esg / Σ esg within each request (ESG NULL counts as 0);
    equal weights when the sum is 0."""
    wp = Window.partitionBy("request_id")
    e = F.coalesce(F.col(esg), F.lit(0.0))
    total = F.sum(e).over(wp)
    return selection.withColumn(
        "weight", F.when(total > 0, e / total).otherwise(1.0 / F.count(F.lit(1)).over(wp)))


def softmax_weights(scores: DataFrame, keys=("portfolio_id", "date"), score: str = "score") -> DataFrame:
    """H8: softmax of ``score`` inside each (portfolio, date)."""
    w = Window.partitionBy(*keys)
    z = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn("_z", z).withColumn(
        "weight", F.col("_z") / F.sum("_z").over(w)).drop("_z")


# ------------------------------------------------------------------- H4

# The guard on requests.
ALLOCATE_MAX = 30
NEGATIVE_AMOUNT = "Investment amount must be positive"


def guard_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H4 guard: (requests to serve, their size capped at ALLOCATE_MAX; refused
    ones as request_id, error). A negative amount is refused, a missing one not."""
    amount = F.col("investment_amount") if "investment_amount" in requests.columns else F.lit(None).cast("double")
    negative = F.coalesce(amount < 0, F.lit(False))
    served = requests.where(~negative)
    if "max_stocks" in requests.columns:
        served = served.withColumn("max_stocks", F.least("max_stocks", F.lit(ALLOCATE_MAX)))
    return served, requests.where(negative).select("request_id", F.lit(NEGATIVE_AMOUNT).alias("error"))


def allocate(metrics: DataFrame, companies: DataFrame, requests: DataFrame,
             method: str = "esg", project: bool = True) -> DataFrame:
    """H4 allocation rows of the requests that pass ``guard_requests``:
    eligible companies only, weights by ``method`` (esg | equal), optionally
    projected (H1); weight rounded to 4 dp, percent text, amount = weight ·
    investment (2 dp). ``by_weight`` orders them as shown."""
    requests, _ = guard_requests(requests)
    sel = select_top(metrics, companies, requests, eligible_only=True)
    sel = esg_weight(sel) if method == "esg" else equal_weight(sel)
    if project:
        sel = project_weights(sel, key="request_id")
    has_amount = "investment_amount" in requests.columns
    amount = (fixed_round(F.col("weight") * F.col("investment_amount"), 2)
              if has_amount else F.lit(None).cast("double"))
    return sel.select(
        "request_id", "symbol", "name", "sector",
        fixed_round("weight", 4).alias("weight"),
        F.format_string("%.1f%%", fixed_round(F.col("weight") * 100, 1)).alias("weight_pct"),
        F.coalesce(F.col("sharpe_252d"), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.col("avg_esg_composite"), F.lit(0.0)).alias("esg"),
        F.when(F.col("investment_amount") > 0, amount).alias("amount") if has_amount
        else amount.alias("amount"),
    )


def by_weight(allocations: DataFrame) -> DataFrame:
    """H4: each request's rows, the largest weight first."""
    return allocations.orderBy("request_id", F.desc("weight"), "symbol")


def allocation_totals(allocations: DataFrame, requests: DataFrame) -> DataFrame:
    """H4 totals per request: weighted Sharpe (3 dp) and ESG (1 dp) from the
    rounded weights, holdings, distinct sectors, and the profile echoes."""
    g = allocations.groupBy("request_id").agg(
        fixed_round(F.sum(F.col("weight") * F.col("sharpe")), 3).alias("weighted_sharpe"),
        fixed_round(F.sum(F.col("weight") * F.col("esg")), 1).alias("weighted_esg"),
        F.count(F.lit(1)).alias("num_holdings"),
        F.count_distinct("sector").alias("sector_count"),
    )
    echo = [c for c in ("risk_tolerance", "esg_importance", "investment_amount")
            if c in requests.columns]
    return g.join(requests.select("request_id", *echo), "request_id")


# -------------------------------------------------------- H5, H6, H7, D3, D4

def analyze(holdings: DataFrame, metrics: DataFrame, companies: DataFrame) -> DataFrame:
    """H5 per-holding rows: weights normalised by the sum of *all* holdings of
    the portfolio (unknown symbols included; 1 when that sum is 0), symbols
    matched upper-case with duplicates summed, weight rounded to 4 dp.
    Keeps the unrounded weight as ``raw_weight`` for sector sums."""
    h = holdings.select("portfolio_id", F.upper(F.trim("symbol")).alias("symbol"), "weight")
    h = h.groupBy("portfolio_id", "symbol").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("portfolio_id"))
    h = h.withColumn("raw_weight",
                     F.col("weight") / F.when(total == 0, F.lit(1.0)).otherwise(total))
    m = latest(metrics, "symbol").select("symbol", "sharpe_252d", "avg_esg_composite",
                                         "annual_volatility", "max_drawdown")
    j = h.join(m, "symbol").join(companies.select("symbol", "name", "sector"), "symbol")
    return j.select(
        "portfolio_id", "symbol", "name", "sector", "raw_weight",
        fixed_round("raw_weight", 4).alias("weight"),
        F.coalesce(F.col("sharpe_252d"), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.col("avg_esg_composite"), F.lit(0.0)).alias("esg"),
        F.coalesce(F.col("annual_volatility"), F.lit(0.0)).alias("volatility"),
        F.coalesce(F.col("max_drawdown"), F.lit(0.0)).alias("max_drawdown"),
    )


def sector_exposure(analysis: DataFrame) -> DataFrame:
    """D4 (long form): Σ unrounded weight by (portfolio, sector), NULL sector
    ignored."""
    return (analysis.where(F.col("sector").isNotNull())
                    .groupBy("portfolio_id", "sector")
                    .agg(F.sum("raw_weight").alias("sector_weight")))


def sector_exposure_map(analysis: DataFrame) -> DataFrame:
    """D4 (map form): one map<sector, weight> per portfolio."""
    return (sector_exposure(analysis).groupBy("portfolio_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("sector", "sector_weight")))
                 .alias("sector_weights")))


def portfolio_totals(analysis: DataFrame) -> DataFrame:
    """D3 + H7: weighted Sharpe (3 dp), ESG (1 dp), volatility (4 dp) from the
    rounded weights; holdings; distinct sectors; diversification
    min(sectors/5, 1); unrounded weighted ESG for the warning rule."""
    g = analysis.groupBy("portfolio_id").agg(
        F.sum(F.col("weight") * F.col("sharpe")).alias("_ws"),
        F.sum(F.col("weight") * F.col("esg")).alias("_we"),
        F.sum(F.col("weight") * F.col("volatility")).alias("_wv"),
        F.count(F.lit(1)).alias("num_holdings"),
        F.count_distinct("sector").alias("sector_count"),
    )
    return g.select(
        "portfolio_id",
        fixed_round("_ws", 3).alias("weighted_sharpe"),
        fixed_round("_we", 1).alias("weighted_esg"),
        fixed_round("_wv", 4).alias("weighted_volatility"),
        "num_holdings", "sector_count",
        F.least(F.col("sector_count") / DIVERSIFIED_SECTORS, F.lit(1.0)).alias("diversification_score"),
        F.col("_we").alias("raw_weighted_esg"),
    )


def _pct0(x: Column) -> Column:
    """Whole-percent text (round half up)."""
    return F.concat(fixed_round(x * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def portfolio_warnings(analysis: DataFrame, n_rows: int | None = None) -> DataFrame:
    """H6: one row per rule hit — holding above 12 %, sector above 35 %,
    fewer than 3 sectors, weighted ESG below 30 — with its message.

    The holdings are dealt by portfolio once; sectors and totals are aggregated
    there, and each portfolio's hits come out of one row. ``n_rows``: about how
    many holdings there are, for the number of partitions."""
    hit = lambda rule, *text: F.struct(F.lit(rule).alias("rule"), F.concat(*text).alias("message"))
    a = analysis.select("portfolio_id", "symbol", "sector", "raw_weight", "weight", "esg")
    a = dealt(a, n_rows, "portfolio_id") if n_rows else a.repartition("portfolio_id")
    position = F.when(F.col("weight") > MAX_WEIGHT, hit(
        "position", F.col("symbol"), F.lit(" weight ("), _pct0(F.col("weight")), F.lit(f") exceeds {round(MAX_WEIGHT * 100)}% limit")))
    by_sector = a.groupBy("portfolio_id", "sector").agg(
        F.sum("raw_weight").alias("_sw"), F.sum(F.col("weight") * F.col("esg")).alias("_we"), F.collect_list(position).alias("_hits"))
    over = F.when(F.col("sector").isNotNull() & (F.col("_sw") > SECTOR_CAP), hit(
        "sector", F.col("sector"), F.lit(" sector ("), _pct0(F.col("_sw")), F.lit(f") exceeds {round(SECTOR_CAP * 100)}% limit")))
    g = by_sector.groupBy("portfolio_id").agg(
        F.count("sector").alias("_sectors"), F.sum("_we").alias("_esg"),
        F.flatten(F.collect_list("_hits")).alias("_hits"), F.collect_list(over).alias("_over"))
    low_div = F.when(F.col("_sectors") < LOW_DIVERSIFICATION_SECTORS, hit(
        "diversification", F.lit("Low diversification: only "), F.col("_sectors").cast("string"), F.lit(" sector(s)")))
    low_esg = F.when(F.col("_esg") < LOW_ESG, hit(
        "esg", F.lit("Low portfolio ESG score ("), F.format_string("%.1f", fixed_round("_esg", 1)), F.lit(")")))
    hits = F.concat("_hits", "_over", F.array_compact(F.array(low_div, low_esg)))
    return g.select("portfolio_id", F.explode(hits).alias("_hit")).select("portfolio_id", "_hit.*")
