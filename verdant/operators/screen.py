"""Screening and ranking.

G1 (composite) and G3 (sector percentile) are columns of the metric recompute
(``verdant.operators.metrics``); this module filters and ranks on them.
Fallback rules that the reference takes with a Python branch are expressed as
scalar subqueries (a one-row aggregate evaluated once) so the plan has no
driver-side decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdant.operators.metrics import HARD_SCREEN_MIN_ESG, sector_rank_pct
from verdant.operators.query import clamp, latest
from verdant.session import checkpoint_dir

# Fixed values of the screening rules.
SOFT_TOP_PCT = 0.5
UNIVERSE_MAX = 30
PARETO_POOL = 100
PARETO_MAX_N = 100
RANGE_ROWS = 100_000          # companies of one Sharpe range


def _joined(metrics: DataFrame, companies: DataFrame) -> DataFrame:
    m = latest(metrics, "symbol")
    return m.join(companies.select("symbol", "name", "sector", "restricted_business",
                                   "severe_controversy"), "symbol")


def hard_screen(metrics: DataFrame, companies: DataFrame,
                min_esg: float = HARD_SCREEN_MIN_ESG) -> DataFrame:
    """Eligible companies — not restricted, no severe controversy,
    ESG ≥ min_esg and the stored eligibility flag set."""
    j = _joined(metrics, companies)
    ok = (~F.col("restricted_business") & ~F.col("severe_controversy")
          & (F.col("avg_esg_composite") >= min_esg) & F.col("eligible_hard_screen"))
    return j.where(F.coalesce(ok, F.lit(False))).select("symbol", "sector", "composite_score")


def soft_screen(eligible: DataFrame, top_pct: float = SOFT_TOP_PCT) -> DataFrame:
    """Best in class — eligible rows with a sector whose composite
    percentile *within the eligible set* of their sector is ≥ top_pct. When no
    eligible row has a sector, every eligible row is kept (rank_pct NULL)."""
    sectored = eligible.where(F.col("sector").isNotNull())
    picked = (sectored.withColumn("rank_pct", sector_rank_pct(sectored))
                      .where(F.col("rank_pct") >= top_pct))
    n_sectored = sectored.select(F.count(F.lit(1))).scalar()
    fallback = (eligible.where(n_sectored == 0)
                        .withColumn("rank_pct", F.lit(None).cast("double")))
    return picked.unionByName(fallback)


def select_universe(metrics: DataFrame, companies: DataFrame,
                    max_stocks: int = UNIVERSE_MAX) -> DataFrame:
    """Hard → soft screen → first ``max_stocks`` by composite (symbol
    breaks ties). When the hard screen is empty: the top ``max_stocks`` of all
    companies by composite."""
    eligible = hard_screen(metrics, companies)
    soft = soft_screen(eligible).select("symbol", "sector", "composite_score")
    n_eligible = eligible.select(F.count(F.lit(1))).scalar()
    everyone = (_joined(metrics, companies).where(n_eligible == 0)
                .select("symbol", "sector", "composite_score"))
    cand = soft.unionByName(everyone)
    return (cand.orderBy(F.desc_nulls_last("composite_score"), F.asc("symbol"))
                .limit(int(max_stocks)))


def pareto(metrics: DataFrame, companies: DataFrame, pool: int | None = None,
           top_n: int = 20, by: str | None = None) -> DataFrame:
    """The first ``top_n`` (1–100) rows of the Sharpe / ESG Pareto frontier,
    walking down by Sharpe (ties: ESG desc, symbol): a company is on it when its
    ESG strictly beats every company above it (start −1). All companies take
    part; the reference looks only at the best ``pool`` by Sharpe, which the
    argument asks for. With ``by`` (e.g. "sector") one frontier per group."""
    top_n = clamp(top_n, 1, PARETO_MAX_N)
    order = [F.desc("sharpe"), F.desc("esg"), F.asc("symbol")]
    front = pareto_all(metrics, companies, by=by, pool=pool)
    keys = [by] if by else []
    if not by:  # first the top n of the whole frontier, then their ranks
        front = front.orderBy(*order).limit(top_n)
    ranked = front.withColumn("frontier_rank", F.row_number().over(
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("frontier_rank") <= top_n).select(*keys, "frontier_rank", "symbol", "name", "sharpe", "esg")


def pareto_all(metrics: DataFrame, companies: DataFrame, by: str | None = None, pool: int | None = None,
               range_rows: int = RANGE_ROWS) -> DataFrame:
    """The whole frontier, as a distributed skyline.

    Rows are cut into Sharpe ranges of about ``range_rows``, as many as the data
    needs, by Spark's range partitioning (equal values share a range), and
    written with their range. Within a range a window finds the rows whose ESG
    beats every better-ranked row of the range; the ranges' maxima (a row a
    range and group) give, for each range, the best ESG of all better ones. A
    row is on the frontier when it beats both — the same answer as one walk down
    the whole ranking, with no single-partition window over the table."""
    keys = [by] if by else []
    order = [F.desc("sharpe_252d"), F.desc("avg_esg_composite"), F.asc("symbol")]
    j = (_joined(metrics, companies)
         .where(F.col("sharpe_252d").isNotNull() & F.col("avg_esg_composite").isNotNull())
         .select(*keys, "symbol", "name", "sharpe_252d", "avg_esg_composite"))
    if pool is not None:
        j = (j.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
              .where(F.col("_pos") <= int(pool)).drop("_pos") if by else j.orderBy(*order).limit(int(pool)))
    ranges = -(-j.count() // range_rows)
    if ranges > 1:                                        # written: each range is read twice and must be the same
        checkpoint_dir(j.sparkSession)
        j = (j.repartitionByRange(ranges, F.desc("sharpe_252d")).withColumn("_b", F.spark_partition_id())
             .checkpoint(eager=True))
    else:
        j = j.withColumn("_b", F.lit(0))
    w_in = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = j.withColumn("_above_in", F.coalesce(F.max("avg_esg_composite").over(w_in), F.lit(-1.0)))
    local = local.where(F.col("avg_esg_composite") > F.col("_above_in"))
    tops = j.groupBy(*keys, "_b").agg(F.max("avg_esg_composite").alias("_bmax"))
    w_b = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_above_out", F.coalesce(F.max("_bmax").over(w_b), F.lit(-1.0)))
    tops = tops.select(*[F.col(k).alias("_k") for k in keys], F.col("_b").alias("_tb"), "_above_out")
    same = F.col("_b") == F.col("_tb")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("_k"))
    front = local.join(tops, same).where(F.col("avg_esg_composite") > F.col("_above_out"))
    return front.select(*keys, "symbol", "name", F.col("sharpe_252d").alias("sharpe"),
                        F.col("avg_esg_composite").alias("esg"))
