"""Delimited files with quoted cells, read by splits.

A quoted cell may hold line ends, so whether a line starts a record depends on
all lines before it. Every line maps the state before it (0: between records,
1: inside a quoted cell) to the state after it; such maps are constant, keep
the state or swap it, and compose. Prefix sums of the swaps since the last
constant line give the state within a split, the same over the splits of a
file gives the state each split begins in, and record numbers are prefix
counts of the starts, per split and then over splits. No window or sort holds
a whole file; a record of several lines is put together by itself.

Line ends are those of universal newlines (``\\n``, ``\\r\\n``, ``\\r``) and read
as ``\\n`` inside cells. Quotes count at the start of a cell only, a doubled
quote inside a quoted cell is one, text after the closing quote belongs to the
cell, and a quote that is never closed reaches to the end of the file, less its
last line end.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

QUOTE = '"'
_INSIDE = re.compile(r'[^"]*(?:""[^"]*)*')


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a quoted cell is open at the end of ``line``, which begins
    inside one or at the start of a record."""
    at = 0
    if not inside and line.startswith(QUOTE):
        inside, at = True, 1
    while True:
        if inside:
            at = _INSIDE.match(line, at).end()
            if at >= len(line):
                return True
            at += 1                                   # the closing quote; the rest of the cell is plain
        at = line.find(delimiter, at) + 1
        if not at:
            return False
        inside = line.startswith(QUOTE, at)
        at += inside


def _line_maps(lines: DataFrame, delimiter: str) -> DataFrame:
    """``lines`` with from0 and from1: the states after a line that begins between records, or inside a cell."""
    names = lines.columns
    at = names.index("line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(at)
            plain = pc.invert(pc.match_substring(text, QUOTE)).to_pylist()
            maps = [(0, 1) if p else (int(ends_inside(t, False, delimiter)), int(ends_inside(t, True, delimiter)))
                    for p, t in zip(plain, text.to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[k] for m in maps], pa.int32()) for k in (0, 1))],
                                             names=[*names, "from0", "from1"])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("from0", "from1"))]))


def _prefix_state(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with before0 and before1: the state before each row when the
    first row of its keys begins in state 0, or 1."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum(F.when((F.col("from0") == 1) & (F.col("from1") == 0), 1).otherwise(0))
    rows = rows.withColumn("odd", swaps.over(so_far) % 2)
    fixed = F.last(F.when(F.col("from0") == F.col("from1"), F.col("from0").bitwiseXOR(F.col("odd").cast("int"))), ignorenulls=True)
    rows = rows.withColumns({"fixed": fixed.over(earlier), "turned": F.coalesce(swaps.over(earlier) % 2, F.lit(0)).cast("int")})
    return rows.withColumns({f"before{i}": F.coalesce("fixed", F.lit(i)).bitwiseXOR(F.col("turned")) for i in (0, 1)}).drop("odd", "fixed", "turned")


@pandas_udf(T.ArrayType(T.StringType()))
def _cells(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    csv.field_size_limit(sys.maxsize)
    return pd.Series([None if t is None else next(csv.reader(io.StringIO(t, newline=""), delimiter=d), [])
                      for t, d in zip(text, delimiter)])


def read_records(spark: SparkSession, path: str, delimiter: str = ",", whole: bool = False) -> DataFrame:
    """file_id (path), row_no (1, 2, … by file, blank records included) and
    text (line ends inside quoted cells kept) of every record under ``path``.
    With ``whole`` the files there are the parts of one, in the order of their
    names, each but the last ending with a line end; its file_id is ``path``."""
    name = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        (F.lit(path) if whole else name).alias("file_id"), F.struct(name, "_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    here = Window.partitionBy("file_id", "split").orderBy("place")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = _prefix_state(_line_maps(lines, delimiter), ["file_id", "split"], "place")
    told = told.withColumns({f"starts{i}": F.sum(F.when(F.col(f"before{i}") == 0, 1).otherwise(0)).over(so_far) for i in (0, 1)})
    after = [F.when(F.col(f"before{i}") == 0, F.col("from0")).otherwise(F.col("from1")) for i in (0, 1)]
    splits = told.groupBy("file_id", "split").agg(
        *[F.max_by(after[i], "place").alias(f"from{i}") for i in (0, 1)], *[F.max(f"starts{i}").alias(f"total{i}") for i in (0, 1)])
    splits = _prefix_state(splits, ["file_id"], "split")             # a row a split
    in_file = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum(F.when(F.col("before0") == 0, F.col("total0")).otherwise(F.col("total1"))).over(in_file), F.lit(0)))
    begun = splits.select("file_id", "split", F.col("before0").alias("begins"), "base")
    known = told.join(begun, ["file_id", "split"])
    before = F.when(F.col("begins") == 0, F.col("before0")).otherwise(F.col("before1"))
    row_no = F.col("base") + F.when(F.col("begins") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    known = known.select("file_id", row_no.cast("bigint").alias("row_no"), "split", "place", "line", "from0", before.alias("before"))
    alone = (F.col("before") == 0) & (F.col("from0") == 0)
    several = (known.where(~alone).groupBy("file_id", "row_no")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "place", "line"))), lambda x: x["line"]), "\n").alias("text")))
    return known.where(alone).select("file_id", "row_no", F.col("line").alias("text")).unionByName(several)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", whole: bool = False) -> DataFrame:
    """file_id, row_no and cells of every record under ``path`` (one file in
    parts with ``whole``); only records with a quote leave the JVM."""
    records = read_records(spark, path, delimiter, whole)
    quoted = F.when(F.contains("text", F.lit(QUOTE)), F.col("text"))
    plain = F.split("text", re.escape(delimiter), -1)
    return records.select("file_id", "row_no", F.coalesce(_cells(quoted, F.lit(delimiter)), plain).alias("cells"))
