"""Model tables: partitions that follow the data."""

import pytest
from pyspark.sql import functions as F

from verdant.sources import tables as T


@pytest.mark.parametrize("rows_per_task,parts", [(100, 20), (10_000_000, None)])
def test_prices_are_dealt_over_as_many_tasks_as_the_rows_need(spark, tmp_path, monkeypatch, rows_per_task, parts):
    monkeypatch.setattr(T, "ROWS_PER_TASK", rows_per_task)
    spark.range(2000).select((F.col("id") % 40).alias("l_suppkey"), F.lit("1995-01-02").cast("timestamp_ntz").alias("l_shipdate"),
                             (F.col("id") * 1.0).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity")
                             ).write.parquet(f"{tmp_path}/lineitem.parquet")
    p = T.prices_daily(spark, str(tmp_path))
    if parts:
        assert p.rdd.getNumPartitions() == parts
    assert p.count() == 40 and p.select(F.sum("volume")).first()[0] == 4000
