"""Inverted lists over unit vectors by a two-level quantiser.

The number of lists follows the data: about one for ``list_rows`` rows, as
coarse × fine centroids. Coarse centroids quantise the vectors, fine ones what
a coarse centroid leaves over, so that L lists take two tables of about √L
vectors, which is all that travels. They are fitted by Spark ML's k-means on at
most ``FIT_ROWS`` rows (smallest key hashes); every row is listed. Lists of
more than ``PIECE_ROWS`` rows are dealt over pieces, so that no task holds a
longer one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT_ROWS = 200_000
PIECE_ROWS = 20_000


@dataclass(frozen=True)
class InvertedLists:
    """``rows``: key, unit, list_id, piece. ``pieces``: list_id, pieces."""
    rows: DataFrame
    pieces: DataFrame
    coarse: np.ndarray
    fine: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)


def _centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    model = KMeans(k=k, seed=seed).fit(rows.select(array_to_vector("unit").alias("features")))
    return np.array(model.clusterCenters(), float)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def _with_residuals(rows: DataFrame, coarse: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                left = x - coarse[_squares(x, coarse).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(left.ravel()))], names=["unit"])
    return rows.select("unit").mapInArrow(run, "unit array<double>")


def build_lists(units: DataFrame, lists: int | None, list_rows: int, seed: int = 7) -> InvertedLists:
    """Lists of ``units`` (key, unit)."""
    spark = units.sparkSession
    n = units.count()
    wanted = lists or max(1, math.ceil(n / list_rows))
    n_coarse = max(1, math.ceil(math.sqrt(wanted)))
    sample = units.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("unit").persist()
    try:
        if n:
            coarse = _centres(sample, n_coarse, seed)
            fine = _centres(_with_residuals(sample, coarse), max(1, math.ceil(wanted / len(coarse))), seed)
        else:
            coarse = fine = np.zeros((1, 1))
    finally:
        sample.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                first = _squares(x, coarse).argmin(axis=1)
                second = _squares(x - coarse[first], fine).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((first * len(fine) + second).astype(np.int32))],
                                                 names=["key", "unit", "list_id"])

    listed = units.select("key", "unit").mapInArrow(run, T.StructType([
        units.schema["key"], T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("list_id", T.IntegerType())]))
    listed = listed.checkpoint(eager=True)
    pieces = listed.groupBy("list_id").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces")).checkpoint(eager=True)
    rows = listed.join(pieces, "list_id").select("key", "unit", "list_id", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int").alias("piece"))
    return InvertedLists(rows, pieces, coarse, fine)


def probed(index: InvertedLists, queries: DataFrame, probes: int) -> DataFrame:
    """query, q_unit, key, unit: every row of the ``probes`` lists nearest to
    each of ``queries`` (key, unit)."""
    coarse, fine = index.coarse, index.fine
    probes = min(probes, index.lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            apart = np.stack([_squares(x - c, fine) for c in coarse], axis=1).reshape(len(x), -1)
            best = np.argsort(apart, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(x)), probes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(best.ravel().astype(np.int32))],
                                             names=["query", "q_unit", "list_id"])

    looks = queries.select("key", "unit").mapInArrow(run, T.StructType([
        T.StructField("query", queries.schema["key"].dataType), T.StructField("q_unit", T.ArrayType(T.DoubleType())),
        T.StructField("list_id", T.IntegerType())]))
    spread = looks.join(index.pieces, "list_id").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    return spread.join(index.rows, ["list_id", "piece"]).select("query", "q_unit", "key", "unit")
