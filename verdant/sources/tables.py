"""Readers for the parquet tables and the model tables derived from them.

The derivation follows FIXTURES.md §3 exactly (decimal sums, one conversion to
double) so Spark and the DuckDB oracle produce bit-equal model tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


ROWS_PER_TASK = 400_000       # of line items that meet in one task


def dealt(rows: DataFrame, n_rows: int, *keys: Column | str) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many partitions as ``n_rows`` need, so
    that a task's memory does not grow with the table (and no fewer than
    Spark's own number, which it may join)."""
    needed = -(-n_rows // ROWS_PER_TASK)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(needed, *keys) if needed > usual else rows.repartition(*keys)


def by_symbol(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` dealt by symbol."""
    return dealt(rows, n_rows, "symbol")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def symbol_of(key: Column | str) -> Column:
    """Ticker for a numeric key: 'S' + six-digit zero-padded key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("S"), F.lpad(k.cast("string"), 6, "0"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """companies(symbol, name, sector, sub_industry, restricted_business,
    severe_controversy) from supplier ⋈ nation ⋈ region."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (s.join(n, s.s_nationkey == n.n_nationkey)
          .join(r, n.n_regionkey == r.r_regionkey))
    return j.select(
        symbol_of("s_suppkey").alias("symbol"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 29 == 7, F.lit(None).cast("string"))
         .otherwise(F.col("r_name")).alias("sector"),
        F.col("n_name").alias("sub_industry"),
        (F.col("s_suppkey") % 17 == 3).alias("restricted_business"),
        (F.col("s_suppkey") % 23 == 5).alias("severe_controversy"),
    )


def prices_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prices_daily(symbol, date, low, high, close, volume): one row per
    supplier and ship date."""
    li = read_table(spark, sf_dir, "lineitem").select(
        symbol_of("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"),
        "l_extendedprice", "l_quantity")
    px = F.col("l_extendedprice").cast("decimal(15,2)")
    # A supplier ships about one line per day, so a map-side partial
    # aggregation would barely shrink the data; shuffling once by symbol lets
    # this aggregation and every per-symbol window downstream share one
    # exchange. The count reads Parquet footers alone.
    g = by_symbol(li, li.count()).groupBy("symbol", "date")
    return g.agg(
        (F.lit(100) + F.min(px).cast("double") / 1000).alias("low"),
        (F.lit(100) + F.max(px).cast("double") / 1000).alias("high"),
        (F.lit(100) + F.sum(px).cast("double") / F.count(F.lit(1)) / 1000).alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )


def esg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """esg_scores(symbol, date, provider, e_score, s_score, g_score,
    composite_score): one row per supplier, ship year and return flag."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    su = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    j = li.join(su, li.l_suppkey == su.s_suppkey)
    n = F.count(F.lit(1))
    g = j.groupBy(
        symbol_of("l_suppkey").alias("symbol"),
        F.make_date(F.year("l_shipdate").cast("int"), F.lit(12), F.lit(31)).alias("date"),
        F.col("l_returnflag").alias("provider"),
    )
    return g.agg(
        (F.sum(F.col("l_discount").cast("decimal(6,2)")).cast("double") / n * 1000).alias("e_score"),
        (F.sum(F.col("l_tax").cast("decimal(6,2)")).cast("double") / n * 1250).alias("s_score"),
        (F.sum(F.col("l_quantity").cast("decimal(6,0)")).cast("double") / n * 2).alias("g_score"),
        (F.greatest(F.lit(0.0), F.max("s_acctbal")) / 100).alias("composite_score"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """holdings(portfolio_id, symbol, weight): one portfolio per customer,
    raw (un-normalised) weights."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    j = o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_custkey").alias("portfolio_id"), symbol_of("l_suppkey").alias("symbol"), "l_extendedprice")
    return (dealt(j, li.count(), "portfolio_id").groupBy("portfolio_id", "symbol")      # lies as every use by portfolio needs it
             .agg(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double").alias("weight")))


class Tables:
    """Lazy accessor for the raw and model tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def companies(self) -> DataFrame:
        return companies(self.spark, self.sf_dir)

    def prices(self) -> DataFrame:
        return prices_daily(self.spark, self.sf_dir)

    def price_rows(self) -> int:
        """Rows the prices come from, by Parquet footers alone."""
        return self.raw("lineitem").count()

    def esg(self) -> DataFrame:
        return esg_scores(self.spark, self.sf_dir)

    def holdings(self) -> DataFrame:
        return holdings(self.spark, self.sf_dir)

    def rebalance(self) -> DataFrame:
        return rebalance_weights(self.spark, self.sf_dir)


def rebalance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebalance weights (portfolio_id, date, symbol, weight): one portfolio
    per customer, rebalanced on each order date; a symbol's weight is its share
    of the day's order value (decimal sums, one conversion to double)."""
    from pyspark.sql import Window
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    j = o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_custkey").alias("portfolio_id"), F.col("o_orderdate").cast("date").alias("date"),
        symbol_of("l_suppkey").alias("symbol"), "l_extendedprice")
    g = (dealt(j, li.count(), "portfolio_id").groupBy("portfolio_id", "date", "symbol")  # one exchange for this and the window
          .agg(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).alias("_v")))
    total = F.sum("_v").over(Window.partitionBy("portfolio_id", "date"))
    return g.select("portfolio_id", "date", "symbol",
                    (F.col("_v").cast("double") / total.cast("double")).alias("weight"))
