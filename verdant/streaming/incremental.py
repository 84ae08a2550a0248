"""K4 — incremental recompute over mergeable states.

A price history is kept as an append log by year and as one state per
(symbol, year) (``functions.segments``). A micro-batch

1. appends its rows to the log of the years it names,
2. reads those years of the symbols it names back (late and restated dates are
   thus rows like any other; the newest arrival of a key wins) and reduces them
   to their states,
3. folds each named symbol's states in year order to its metrics (E1–E9),
4. ranks the sectors of those symbols again (G3, D2).

Other years' rows, other buckets' states and other sectors' metrics are neither
read nor written: states are kept by bucket of symbols, metrics and rankings by
sector, as ``sources.versions``. Metrics equal E10 on the same rows, however
they are dealt over batches. Rows without symbol, date or close change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.functions import segments as G
from verdant.operators import metrics as M
from verdant.sources.tables import ROWS_PER_TASK, dealt
from verdant.sources.versions import PART, VersionedParts

BUCKETS = 64                  # of symbols, by hash
PRICE_ROWS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()),
                           T.StructField("close", T.DoubleType())])
_STATES = f"symbol string, year int, state {G.STATE}"
_METRICS = ("symbol string, sector string, " + ", ".join(f"{c} double" for c in [*M.METRIC_COLUMNS, *M.ESG_COLUMNS, "composite_score"])
            + ", eligible_hard_screen boolean, sector_rank_pct double, n_closes bigint, n_returns bigint, as_of_date date")
_SECTORS = ("sector string, as_of_date date, company_count bigint, avg_sharpe double, avg_esg double, "
            "avg_volatility double, avg_return double, composite_score double")


def _bucket(symbol: str = "symbol") -> Column:
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(symbol), F.lit(BUCKETS)).cast("string"))


def _sector_part(sector: str = "sector") -> Column:
    return F.when(F.col(sector).isNull(), F.lit("none")).otherwise(F.concat(F.lit("s"), F.hex(sector)))


class IncrementalMetrics:
    """The tables of one incremental recompute under ``root``."""

    def __init__(self, spark: SparkSession, root: str, esg: DataFrame, companies: DataFrame):
        self.spark, self.root, self.esg, self.companies = spark, root.rstrip("/"), esg, companies
        self.states = VersionedParts(spark, f"{self.root}/states", _STATES)
        self.metrics = VersionedParts(spark, f"{self.root}/metrics", _METRICS)
        self.sectors = VersionedParts(spark, f"{self.root}/sectors", _SECTORS)

    # ------------------------------------------------------------- the batch

    def apply(self, batch: DataFrame, batch_id: int, as_of: Column | None = None) -> None:
        """Bring all tables up to ``batch`` (symbol, date, close, and ``arrival``
        where rows of one key can stand in it twice). Replaying a batch id
        gives the same tables. ``as_of`` defaults to the newest date so far."""
        rows = batch.where("symbol is not null and date is not null and close is not null")
        if "arrival" not in rows.columns:
            rows = rows.withColumn("arrival", F.lit(0))
        (rows.select("symbol", "date", "close", F.to_json(F.struct("arrival")).alias("arrival"), F.year("date").alias("year"))
             .write.mode("overwrite").partitionBy("year").parquet(f"{self.root}/prices/batch_id={batch_id}"))
        log = self._log()
        named = log.where(F.col("batch_id") == batch_id).select("symbol", "year").distinct().persist()
        try:
            years = [r.year for r in named.select("year").distinct().collect()]        # as many as the batch names
            if not years:
                return
            self._restate(log.where(F.col("year").isin(years) & (F.col("batch_id") <= batch_id)), named, batch_id)
            self._measure(named.select("symbol").distinct(), batch_id, as_of)
        finally:
            named.unpersist()
        for table in (self.states, self.metrics, self.sectors):
            table.prune(batch_id)

    def _log(self) -> DataFrame:
        schema = T.StructType([*PRICE_ROWS.fields, T.StructField("arrival", T.StringType()),
                               T.StructField("batch_id", T.LongType()), T.StructField("year", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/prices").parquet(f"{self.root}/prices")

    def _restate(self, history: DataFrame, named: DataFrame, version: int) -> None:
        """New states of the named (symbol, year), from those years' rows alone."""
        n_rows = history.count()                                                       # by footers
        mine = dealt(history, n_rows, "symbol", "year").join(dealt(named, n_rows, "symbol", "year"), ["symbol", "year"], "left_semi")
        closes = mine.groupBy("symbol", "year", "date").agg(
            F.max_by("close", F.struct("batch_id", "arrival")).alias("close"))
        fresh = G.segment_states(closes, ["symbol", "year"]).withColumn(PART, _bucket())
        buckets = [r[0] for r in named.select(_bucket()).distinct().collect()]         # BUCKETS at most
        kept = self.states.read(buckets, before=version).join(named, ["symbol", "year"], "left_anti")
        self.states.write(dealt(kept.unionByName(fresh), n_rows, PART, F.pmod(F.xxhash64("symbol"), F.lit(n_rows // ROWS_PER_TASK + 1))), version)

    def _measure(self, touched: DataFrame, version: int, as_of: Column | None) -> None:
        known = self.companies.select("symbol", "sector", "restricted_business", "severe_controversy")
        mine = known.join(touched, "symbol", "left_semi")
        buckets = [r[0] for r in touched.select(_bucket()).distinct().collect()]
        years = self.states.read(buckets, before=version + 1).join(touched, "symbol", "left_semi")
        whole = years.groupBy("symbol").agg(G.fold(F.transform(
            F.array_sort(F.collect_list(F.struct("year", "state"))), lambda x: x["state"])).alias("state"))
        cols = G.metric_columns(F.col("state"), M.MIN_RETURNS)
        fresh = (whole.where(F.col("state.n") >= M.MIN_CLOSES).select("symbol", *[c.alias(k) for k, c in cols.items()])
                 .join(mine, "symbol").join(M.esg_averages(self.esg.join(touched, "symbol", "left_semi")), "symbol", "left"))
        day = as_of if as_of is not None else F.lit(self._newest_date())
        fresh = (fresh.withColumn("composite_score", M.composite_score()).withColumn("eligible_hard_screen", M.hard_screen_flag())
                 .withColumn(PART, _sector_part()).withColumn("as_of_date", day).withColumn("sector_rank_pct", F.lit(None).cast("double")))
        names = [*self.metrics.schema.names, PART]
        parts = [r[0] for r in mine.select(_sector_part()).distinct().collect()]       # sectors, a small dimension
        kept = self.metrics.read(parts, before=version).join(touched, "symbol", "left_anti")
        merged = kept.select(*names).unionByName(fresh.select(*names)).withColumn("as_of_date", day)
        self.metrics.write(merged.withColumn("sector_rank_pct", M.sector_rank_pct(merged)), version)
        again = self.metrics.read(parts, before=version + 1)
        ranked = M.sector_rankings(again.drop("sector"), self.companies)
        self.sectors.write(ranked.withColumn(PART, _sector_part()), version)

    def _newest_date(self):
        """The newest date of the log: only its last year is read."""
        log = self._log()
        last = log.select(F.max("year")).first()[0]
        return log.where(F.col("year") == last).select(F.max("date")).first()[0]

    # --------------------------------------------------------- the read side

    def _of_one_day(self, table: VersionedParts) -> DataFrame:
        rows = table.read().drop(PART)
        return rows.withColumn("as_of_date", rows.select(F.max("as_of_date")).scalar())

    def current_metrics(self) -> DataFrame:
        """computed_metrics as of the newest batch (columns of E10)."""
        rows = self._of_one_day(self.metrics)
        return rows.select("symbol", "as_of_date", *M.METRIC_COLUMNS, *M.ESG_COLUMNS, "composite_score",
                           "eligible_hard_screen", "sector_rank_pct", "n_closes", "n_returns")

    def current_sectors(self) -> DataFrame:
        """sector_rankings as of the newest batch (columns of D2)."""
        return self._of_one_day(self.sectors)


def recompute_stream(tables: IncrementalMetrics, source: str, ckpt: str, files_per_trigger: int = 1,
                     as_of: Column | None = None):
    """K4 as a stream over files of (symbol, date, close): each micro-batch
    goes through ``IncrementalMetrics.apply``; within one, the newer file and
    the later row of a file win."""
    src = (tables.spark.readStream.schema(PRICE_ROWS).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
           .select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("file")))

    def batch(df: DataFrame, batch_id: int) -> None:
        place = F.struct("file.file_modification_time", "file.file_path", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0").alias("place"))
        tables.apply(df.withColumn("arrival", place).drop("file"), batch_id, as_of)

    return src.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
