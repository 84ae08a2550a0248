"""Per-key sequential passes (recurrences) without per-group overhead.

A recurrence such as an EMA or a differential Sharpe ratio has no window
form. Rather than one pandas DataFrame per key (``applyInPandas``), rows are
shuffled once by key, sorted within each partition by (key, order), and a
``mapInPandas`` function walks each partition's Arrow batches, calling a
NumPy kernel on each key's contiguous run. A key's rows may straddle two
batches; its run is carried into the next batch, so a kernel always sees one
key's whole history (bounded by that key's length, never by the partition).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Kernel = Callable[[pd.DataFrame], pd.DataFrame]


def run_by_key(df: DataFrame, key: str, order: str, kernel: Kernel, schema: T.StructType,
               num_partitions: int | None = None) -> DataFrame:
    """Apply ``kernel`` (one key's rows, sorted by ``order`` → output rows)
    to every key of ``df``."""
    parts = df.repartition(num_partitions, key) if num_partitions else df.repartition(key)
    parts = parts.sortWithinPartitions(key, order)
    return parts.mapInPandas(lambda batches: _runs(batches, key, lambda pdf: _apply(pdf, key, kernel)), schema)


def run_values(df: DataFrame, key: str, order: str, value: str,
               kernel: Callable[[np.ndarray], tuple[np.ndarray, ...]], schema: T.StructType) -> DataFrame:
    """As ``run_by_key`` for kernels that take one column, as an array, to one
    array per column of ``schema`` after key and order: no frame per key. Rows
    that lie by key already are not exchanged; rows without a key stand alone."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = df.select(key, order, value, nth.alias("_nth")).sortWithinPartitions(key, order)
    names = schema.names[2:]

    def begins(pdf: pd.DataFrame) -> np.ndarray:
        return np.flatnonzero((pdf["_nth"].to_numpy() == 1) | pdf[key].isna().to_numpy())

    def apply(pdf: pd.DataFrame) -> pd.DataFrame | None:
        if not len(pdf):
            return None
        x = pdf[value].to_numpy(dtype="float64")
        starts = begins(pdf)
        outs = [kernel(x[s:e]) for s, e in zip(starts, np.r_[starts[1:], len(x)])]
        return pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy(),
                             **{n: np.concatenate(c) for n, c in zip(names, zip(*outs))}})

    def cut(pdf: pd.DataFrame) -> int:
        return int(begins(pdf)[-1])

    return rows.mapInPandas(lambda batches: _runs(batches, key, apply, cut), schema)


def _runs(batches: Iterator[pd.DataFrame], key: str, apply, cut=None) -> Iterator[pd.DataFrame]:
    """``apply`` to whole runs of keys. Rows are sorted by key, so the last key's
    rows are a suffix; they may continue in the next batch and are carried over."""
    carry: pd.DataFrame | None = None
    for pdf in batches:
        if carry is not None and len(carry):
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if not len(pdf):
            continue
        if cut is None:
            keys = pdf[key].to_numpy()
            at = int(np.argmax(keys == keys[-1]))
        else:
            at = cut(pdf)
        done, carry = pdf.iloc[:at], pdf.iloc[at:]
        out = apply(done)
        if out is not None:
            yield out
    if carry is not None and len(carry):
        out = apply(carry)
        if out is not None:
            yield out


def _apply(pdf: pd.DataFrame, key: str, kernel: Kernel) -> pd.DataFrame | None:
    if not len(pdf):
        return None
    keys = pdf[key].to_numpy()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    outs = [kernel(pdf.iloc[s:e]) for s, e in zip(starts, ends)]
    return pd.concat(outs, ignore_index=True) if outs else None
