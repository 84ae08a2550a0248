"""Registered queries for the streaming jobs (K). Each one writes its input
as a sequence of files under the shared checkpoint folder (a fresh folder per
run), drains the stream with an available-now trigger in several micro-batches,
and returns the resulting table — which must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import risk
from verdant.operators import backtest as B
from verdant.streaming import incremental as I
from verdant.streaming import pipelines as K
from verdant.plans.catalog import register
from verdant.plans.queries_models import _DSR_SQL_BODY

_SECTORS_SQL = """
select sector, as_of_date, company_count, round(avg_sharpe, 6) as avg_sharpe,
  round(avg_esg, 6) as avg_esg, round(avg_volatility, 6) as avg_volatility,
  round(avg_return, 6) as avg_return, round(composite_score, 6) as composite_score
from m_sector_rankings"""
_FILES = 4                    # files of one part, which one micro-batch takes together: at least,
_ROWS_PER_FILE = 500_000      # and so many that none holds many more rows
_ROWS_PER_BUCKET = 5_000      # returns of the portfolios that share an entry of the state store, about


def _files(rows: int, parts: int = 1) -> int:
    return max(_FILES, -(-rows // (parts * _ROWS_PER_FILE)))


def _whole(df, path: str):
    """``df`` written once, for inputs that are looked at several times."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_in_order(df, key, parts: int, path: str, by: str | None = None) -> int:
    """Write ``df`` as ``parts`` folders in ascending ``key`` order (nulls
    first), so that a file source, which takes files by modification time, sees
    the parts in that order; with ``by``, rows of one value stay in one file of
    each part. Split points are approximate quantiles. Returns the number of
    files of each part."""
    files = _files(df.count(), parts)
    bounds = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)])).first()[0] or []
    edges = [None, *sorted(set(bounds)), None]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = F.lit(True) if lo is None else key > lo
        inside = inside if hi is None else inside & (key <= hi)
        part = df.where(inside | key.isNull() if lo is None else inside)
        (part.repartition(files, by) if by else part.repartition(files)).write.parquet(f"{path}/p{i}")
    return files


def _drain(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@register("k1_ingest_stream", """
select symbol, date, cast(null as double) as open, round(high, 6) as high, round(low, 6) as low,
  round(close, 6) as close, volume from m_prices""")
def k1_ingest_stream(t):
    """K1: the whole price table arriving as JSON record files (plus a
    re-upload of one year), ingested in micro-batches; the latest-wins table
    equals the source."""
    spark = t.spark
    root = K.scratch(spark, "k1")
    p = t.prices()
    rec = p.select("symbol", F.col("date").cast("string").alias("date"), F.lit(None).cast("string").alias("open"),
                   F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"),
                   F.col("close").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"))
    rec = _whole(rec, f"{root}/records")
    files = _files(rec.count())
    rec.repartitionByRange(files, "date").write.json(f"{root}/src/part1")
    rec.where(F.year(F.col("date").cast("date")) == 1995).repartition(max(2, files // 4)).write.json(f"{root}/src/part2")
    q = K.ingest_stream(spark, f"{root}/src/*", f"{root}/log", f"{root}/rejects", f"{root}/ckpt",
                        today="2100-01-01", files_per_trigger=files // 2)
    _drain(q)
    return K.current_prices(spark, f"{root}/log")


@register("k2_progress_stream", """
select user_id as job_id, date_trunc('hour', ts) as window_start, count(*) as chunks,
  count(*) filter (where event_type = 'error') as errors,
  cast(sum(case when event_type != 'error' then cast(nullif(regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1), '') as bigint) end)
    as bigint) as records
from events group by 1, 2""")
def k2_progress_stream(t):
    """K2: job progress per hour from the event table streamed in order."""
    spark = t.spark
    root = K.scratch(spark, "k2")
    ev = t.raw("events")
    files = _write_in_order(ev, F.unix_micros(F.col("ts").cast("timestamp")), 5, f"{root}/src")
    q = K.progress_stream(spark, f"{root}/src/*", f"{root}/sink", f"{root}/ckpt", ev.schema,
                          job=F.col("user_id"), ts=F.col("ts"), failed=F.col("event_type") == "error",
                          records=F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1).try_cast("bigint"),
                          window="1 hour", delay="10 minutes", files_per_trigger=files)
    _drain(q)
    return K.current_progress(spark, f"{root}/sink")


@register("k3_streaming_dsr", f"""
select * from (
with recursive {_DSR_SQL_BODY}
select portfolio_id, date, round(dsr, 6) as dsr from d) q""")
def k3_streaming_dsr(t):
    """K3: differential Sharpe of every portfolio's returns, carried in the
    state store across micro-batches (date-ordered files)."""
    spark = t.spark
    root = K.scratch(spark, "k3")
    returns = risk.return_path(t.prices()).where(F.col("ret").isNotNull()).select("symbol", "date", "ret")
    pr = B.portfolio_returns(t.rebalance(), returns, t.price_rows()).select(
        F.col("portfolio_id").cast("bigint"), "date", "port_return")
    pr = _whole(pr, f"{root}/returns")
    files = _write_in_order(pr, F.unix_date("date"), 4, f"{root}/src", by="portfolio_id")
    q = K.differential_sharpe_stream(spark, f"{root}/src/*", f"{root}/sink", f"{root}/ckpt", files_per_trigger=files,
                                     ttl_days=40 * 365, buckets=max(64, pr.count() // _ROWS_PER_BUCKET))
    _drain(q)
    out = spark.read.parquet(f"{root}/sink")
    return out.where(~F.col("late")).select("portfolio_id", "date", "dsr")


@register("k4_incremental_recompute", """
select symbol, as_of_date, round(annual_return, 6) as annual_return, round(annual_volatility, 6) as annual_volatility,
  round(sharpe_252d, 6) as sharpe_252d, round(sortino_252d, 6) as sortino_252d, round(calmar_ratio, 6) as calmar_ratio,
  round(max_drawdown, 6) as max_drawdown, round(momentum_20d, 6) as momentum_20d, round(momentum_60d, 6) as momentum_60d,
  round(avg_esg_composite, 6) as avg_esg_composite, round(composite_score, 6) as composite_score,
  eligible_hard_screen, round(sector_rank_pct, 6) as sector_rank_pct
from m_metrics""")
def k4_incremental_recompute(t):
    """K4: the price table arriving in batches that cut histories by date and
    by symbol, with late dates and wrong closes restated later; the metric
    table equals a full recompute."""
    m = _recomputed(t, K.scratch(t.spark, "k4")).current_metrics()
    return m.select("symbol", "as_of_date", "annual_return", "annual_volatility", "sharpe_252d", "sortino_252d",
                    "calmar_ratio", "max_drawdown", "momentum_20d", "momentum_60d", "avg_esg_composite",
                    "composite_score", "eligible_hard_screen", "sector_rank_pct")


def _recomputed(t, root: str) -> I.IncrementalMetrics:
    """Stream the price table in four batches: the first years (a sixth of the
    dates missing, every ninth close wrong), the later years, what was missing,
    and a quarter of the symbols once more, wrong closes corrected."""
    spark = t.spark
    p = _whole(t.prices().select("symbol", "date", "close"), f"{root}/prices")
    early = F.year("date") <= 1995
    late = F.pmod(F.xxhash64("symbol", "date"), F.lit(6)) == 0
    wrong = early & (F.pmod(F.xxhash64("date", "symbol"), F.lit(9)) == 0)
    quarter = F.pmod(F.xxhash64("symbol"), F.lit(4)) == 0
    batches = [p.where(early & ~late).withColumn("close", F.when(wrong, F.col("close") * 1.1).otherwise(F.col("close"))),
               p.where(~early), p.where(early & late), p.where(quarter | wrong)]
    files = _files(p.count())
    for k, rows in enumerate(batches):
        rows.repartition(files, "symbol").write.parquet(f"{root}/src/p{k}")
    as_of = F.lit(p.select(F.max("date")).first()[0])
    tables = I.IncrementalMetrics(spark, f"{root}/tables", t.esg(), t.companies())
    _drain(I.recompute_stream(tables, f"{root}/src/*", f"{root}/ckpt", files_per_trigger=files, as_of=as_of))
    return tables


@register("k4_incremental_sectors", _SECTORS_SQL)
def k4_incremental_sectors(t):
    """K4: the sector table after the same batches equals a full ranking."""
    return _recomputed(t, K.scratch(t.spark, "k4s")).current_sectors()
