"""Structured Streaming jobs (K1–K3; K4 is ``streaming.incremental``).

* K1 ``ingest_stream`` — a file source of price records; each micro-batch is
  coerced, validated and written to a batch-id partition of an append log, so
  a replayed batch overwrites its own output (idempotent). Lines that are no
  record, records that cannot be typed and rows that fail validation go to the
  reject log with their reason. The current table is the last-arrival view of
  the log.
* K2 ``progress_stream`` — job progress per event-time window with a watermark,
  so finished windows leave the state store.
* K3 ``differential_sharpe_stream`` — the (A, B) moments of the differential
  Sharpe ratio carried per portfolio in the state store, by buckets of portfolios
  (``applyInPandasWithState``); rows at or before a portfolio's last processed date
  are late and marked so; a portfolio not seen for the time-to-live leaves the store.

Checkpoints and sinks live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.operators import ingest as A
from verdant.session import checkpoint_dir

PRICE_RECORD_SCHEMA = T.StructType([
    T.StructField(c, T.StringType()) for c in ("symbol", "date", "open", "high", "low", "close", "volume")
])
BROKEN = "_corrupt_record"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------------- K1

def ingest_stream(spark: SparkSession, source: str, log_path: str, reject_path: str,
                  ckpt: str, today: str, files_per_trigger: int = 1, fmt: str = "json"):
    """K1: start the ingestion stream (returns the StreamingQuery)."""
    lines = T.StructType([*PRICE_RECORD_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])
    src = (spark.readStream.schema(lines).format(fmt).option("columnNameOfCorruptRecord", BROKEN)
           .option("maxFilesPerTrigger", files_per_trigger).load(source)
           .select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("_file")))

    def batch(df: DataFrame, batch_id: int) -> None:
        # arrival: the file's time and name, then the place in it
        arrived = df.withColumn("arrival", F.struct(F.col("_file.file_modification_time").alias("time"),
                                                    F.col("_file.file_path").alias("path"),
                                                    F.monotonically_increasing_id().alias("place")))
        rec = arrived.select("arrival", BROKEN, F.create_map(
            *[x for c in PRICE_RECORD_SCHEMA.fieldNames() for x in (F.lit(c), F.col(c))]).alias("record"))
        checked = A.validate_prices(A.split_prices(rec, apart=False), today)
        typed = ["symbol", "date", "open", "high", "low", "close", "volume"]
        malformed, untyped, invalid = F.col(BROKEN).isNotNull(), F.col("reject_reason").isNotNull(), F.col("status") == "rejected"
        reason = (F.when(malformed, F.lit("malformed")).when(untyped, F.col("reject_reason"))
                   .when(invalid, F.array_join("errors", ",")))
        raw = (F.when(malformed, F.col(BROKEN)).when(untyped, F.to_json("record"))
                .when(invalid, F.to_json(F.struct(*typed))))
        # both logs take from it: lines are parsed, read and checked once
        done = checked.select("arrival", *typed, raw.alias("raw"), reason.alias("reason")).persist()
        try:
            done.where(F.col("reason").isNull()).drop("raw", "reason").write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
            (done.where(F.col("reason").isNotNull()).select("arrival", "raw", "reason")
                 .write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}"))
        finally:
            done.unpersist()

    return (src.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
               .trigger(availableNow=True).start())


def current_prices(spark: SparkSession, log_path: str) -> DataFrame:
    """K1 read side: the last arrival of every key in the append log."""
    log = _read_log(spark, log_path)
    cols = [c for c in log.columns if c not in ("symbol", "date", "batch_id", "arrival")]
    last = F.max_by(F.struct(*cols), F.struct("batch_id", "arrival")).alias("_r")
    return log.groupBy("symbol", "date").agg(last).select("symbol", "date", *[F.col(f"_r.{c}").alias(c) for c in cols])


# ---------------------------------------------------------------------- K2

def progress_stream(spark: SparkSession, source: str, sink: str, ckpt: str, schema: T.StructType,
                    job: Column, ts: Column, failed: Column, records: Column,
                    window: str = "1 hour", delay: str = "10 minutes", files_per_trigger: int = 1):
    """K2: per job and event-time window — chunks, errors, records stored of
    the chunks that did not fail; the columns are expressions over ``schema``.
    Update mode: each micro-batch emits the windows it changed, written to its
    batch-id partition (replay-safe); a watermark bounds the state, dropping
    windows older than ``delay`` behind the newest event. Read the current
    progress with ``current_progress``."""
    # Event time must be a TIMESTAMP for the watermark. Wall-clock (NTZ)
    # values are mapped to the instant with the same wall clock in UTC, so
    # windows align to wall-clock hours whatever the session time zone; the
    # window start is mapped back the same way.
    tz = F.current_timezone()
    ev = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
          .parquet(source).select(job.alias("job_id"), F.to_utc_timestamp(ts.cast("timestamp"), tz).alias("ts"),
                                  failed.alias("failed"), records.cast("bigint").alias("n")))
    g = (ev.withWatermark("ts", delay)
           .groupBy("job_id", F.window("ts", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("chunks"), F.count_if("failed").alias("errors"),
                F.sum(F.when(~F.col("failed"), F.col("n"))).alias("records")))
    out = g.select("job_id", F.from_utc_timestamp(F.col("w.start"), tz).cast("timestamp_ntz").alias("window_start"),
                   "chunks", "errors", "records")

    def batch(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint")) \
          .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (out.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
               .outputMode("update").trigger(availableNow=True).start())


def current_progress(spark: SparkSession, sink: str) -> DataFrame:
    """K2 read side: newest emitted value per (job, window)."""
    log = spark.read.parquet(sink)
    cols = ["chunks", "errors", "records"]
    return A.upsert(log.limit(0).select("job_id", "window_start", *cols),
                    log.select("job_id", "window_start", *cols, F.col("batch_id").alias("seq")),
                    ["job_id", "window_start"])


# ---------------------------------------------------------------------- K3

DSR_OUT = T.StructType([
    T.StructField("portfolio_id", T.LongType()), T.StructField("known", T.BooleanType()), T.StructField("day", T.IntegerType()),
    T.StructField("port_return", T.DoubleType()), T.StructField("dsr", T.DoubleType()),
    T.StructField("late", T.BooleanType()),
])
DSR_STATE = T.StructType([       # the portfolios of a bucket, side by side
    T.StructField("portfolio_id", T.ArrayType(T.LongType())), T.StructField("a", T.ArrayType(T.DoubleType())),
    T.StructField("b", T.ArrayType(T.DoubleType())), T.StructField("last_day", T.ArrayType(T.IntegerType())),
    T.StructField("expires_ms", T.ArrayType(T.LongType())),
])
DAY_MS = 86_400_000


def _dsr_state_fn(eta: float):
    from verdant.operators.backtest import DSR_A0, DSR_B0, dsr_step

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts = [] if state.hasTimedOut else list(pdfs)
        held = {i: v for i, *v in zip(*state.get)} if state.exists else {}      # portfolio → a, b, last day, expiry
        now, seen = state.getCurrentWatermarkMs(), set()
        if parts:
            pdf = pd.concat(parts, ignore_index=True).sort_values("day", kind="stable")
            ids = [i if k else None for i, k in zip(pdf["portfolio_id"].tolist(), pdf["known"].tolist())]
            days = [None if d != d else int(d) for d in pdf["day"].tolist()]    # a row without a date comes last
            values, late = [], []
            for i, d, r in zip(ids, days, pdf["port_return"].tolist()):
                a, b, last, _ = held.get(i) or (DSR_A0, DSR_B0, None, 0)
                value, behind = None, last is not None and d <= last
                if not behind:
                    a, b, value = dsr_step(a, b, r, eta)
                    last = d
                held[i] = a, b, last, 0
                seen.add(i)
                values.append(float("nan") if value is None else value)
                late.append(behind)
            yield pd.DataFrame({"portfolio_id": pdf["portfolio_id"].to_numpy(), "known": pdf["known"].to_numpy(), "day": days,
                                "port_return": pdf["port_return"].to_numpy(), "dsr": values, "late": late})
        for i in seen:
            a, b, last, _ = held[i]
            held[i] = a, b, last, max((last or 0) * DAY_MS, now + 1)
        held = {i: v for i, v in held.items() if i in seen or v[3] >= now}      # the others' time is over
        if not held:
            state.remove()
            return
        columns = [list(c) for c in zip(*held.values())]
        state.update((list(held), *columns))
        state.setTimeoutTimestamp(max(min(columns[3]), now + 1))

    return fn


def differential_sharpe_stream(spark: SparkSession, source: str, sink: str, ckpt: str,
                               eta: float = 0.01, files_per_trigger: int = 1, ttl_days: int = 400,
                               buckets: int = 1024):
    """K3: start the stateful differential-Sharpe stream over
    (portfolio_id, date, port_return) files. A portfolio whose last row is
    ``ttl_days`` older than the newest of all loses its state and starts anew
    when it returns; rows that old are beyond the watermark and not processed.

    The state store keeps the portfolios of one of ``buckets`` hash buckets as
    one entry, so that Python is called once a bucket and not once a portfolio;
    each portfolio has its own moments, last date and expiry there. ``buckets``
    stays as it is for the life of a checkpoint."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = T.StructType([T.StructField("portfolio_id", T.LongType()), T.StructField("date", T.DateType()),
                           T.StructField("port_return", T.DoubleType())])
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source))
    # an id that is NULL travels as 0, not known: beside NULLs, pandas would round large ids
    timed = src.select(F.pmod(F.xxhash64("portfolio_id"), F.lit(buckets)).alias("bucket"),
                       F.coalesce("portfolio_id", F.lit(0)).alias("portfolio_id"), F.col("portfolio_id").isNotNull().alias("known"),
                       F.unix_date("date").alias("day"), "port_return",
                       F.col("date").cast("timestamp").alias("ts")).withWatermark("ts", f"{ttl_days} days")
    out = timed.groupBy("bucket").applyInPandasWithState(
        _dsr_state_fn(eta), DSR_OUT, DSR_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    out = out.select(F.when(F.col("known"), F.col("portfolio_id")).alias("portfolio_id"),
                     F.date_from_unix_date("day").alias("date"), "port_return", "dsr", "late")
    return (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
               .outputMode("append").trigger(availableNow=True).start())
