"""Gap-aware EMA / MACD by a segmented prefix scan.

On a common calendar a symbol has dates without a close. Its EMA stays there,
its weight decays by (1 − α) a date, and the next close is mixed in with that
weight: after g dates, y ← (w·y + α·x) / (w + α), w = (1 − α)^g (g = 1 gives the
plain recurrence). The signal line, an EMA of fast − slow, moves on every date
from the first close on.

Both are affine in (fast, slow, signal), and affine maps compose, so a key's
calendar is cut into blocks of ``block`` dates that need not meet in one task:
one pass reduces every block but the last to its map, the maps of a key are
folded in order (a few rows a key) to the state each block starts from, and a
last pass walks the blocks from there.

In a gap the EMAs stay and the signal nears their difference by its share a
date, so the histogram of a date is that of the last close times (1 − α)^dates.
``macd_at_closes`` therefore walks the closes alone, one key after the other,
and leaves the gaps to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.functions.sequential import run_by_key

BLOCK = 4096                  # calendar dates of one block
_MAP = ["rows", "lead", "tail", "x", "a_fast", "b_fast", "a_slow", "b_slow", "keep", "of_fast", "of_slow", "shift"]
_STATE = ["started", "fast", "slow", "signal", "since"]


def _double(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _weights(gap: float, alpha: float) -> tuple[float, float]:
    """What the old value and the new close count for after ``gap`` dates."""
    old = (1.0 - alpha) ** gap
    return old / (old + alpha), alpha / (old + alpha)


def _block_map(key: str, spans: tuple[int, int, int]):
    fast, slow, sig = (2.0 / (s + 1.0) for s in spans)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["close"].to_numpy(dtype="float64")
        seen = [i for i, v in enumerate(x.tolist()) if v == v]
        lead = seen[0] if seen else len(x)
        last = lead
        a1, b1, a2, b2, keep, p1, p2, shift = 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0
        for i in range(lead + 1, len(x)):
            v = x[i]
            if v == v:
                (o1, n1), (o2, n2) = _weights(i - last, fast), _weights(i - last, slow)
                a1, b1, a2, b2, last = o1 * a1, o1 * b1 + n1 * v, o2 * a2, o2 * b2 + n2 * v, i
            keep, p1, p2, shift = ((1 - sig) * keep, (1 - sig) * p1 + sig * a1, (1 - sig) * p2 - sig * a2,
                                   (1 - sig) * shift + sig * (b1 - b2))
        first = float(x[lead]) if seen else float("nan")
        row = [len(x), lead, len(x) - 1 - last, first, a1, b1, a2, b2, keep, p1, p2, shift]
        return pd.DataFrame([[pdf[key].iloc[0], pdf["block"].iloc[0], *map(float, row)]], columns=[key, "block", *_MAP])

    return kernel


def _fold(key: str, spans: tuple[int, int, int]):
    alphas = [2.0 / (s + 1.0) for s in spans]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        started, y1, y2, s, since = 0.0, 0.0, 0.0, 0.0, 0.0
        out = []
        for m in pdf.itertuples(index=False):
            lead = m.lead
            if started:                                      # dates before the block's first close
                keep = (1 - alphas[2]) ** lead
                s = keep * s + (1 - keep) * (y1 - y2)
            if lead < m.rows:
                if started:
                    (o1, n1), (o2, n2) = (_weights(since + lead + 1, a) for a in alphas[:2])
                    y1, y2 = o1 * y1 + n1 * m.x, o2 * y2 + n2 * m.x
                    s = (1 - alphas[2]) * s + alphas[2] * (y1 - y2)
                else:
                    started, y1, y2, s = 1.0, m.x, m.x, 0.0
                s = m.keep * s + m.of_fast * y1 + m.of_slow * y2 + m.shift
                y1, y2 = m.a_fast * y1 + m.b_fast, m.a_slow * y2 + m.b_slow
                since = m.tail
            else:
                since += m.rows
            out.append([getattr(m, key), m.block + 1, started, y1, y2, s, since])
        return pd.DataFrame(out, columns=[key, "block", *_STATE])

    return kernel


def _walk(key: str, spans: tuple[int, int, int]):
    a1, a2, a3 = (2.0 / (s + 1.0) for s in spans)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        started, y1, y2, s, since = (float(pdf[c].iloc[0]) for c in _STATE)
        rows = []
        for x in pdf["close"].to_numpy(dtype="float64").tolist():
            since += 1
            if x == x:
                if not started:
                    started, y1, y2, s = 1.0, x, x, 0.0
                else:
                    (o1, n1), (o2, n2) = _weights(since, a1), _weights(since, a2)
                    y1 = y1 if y1 == x else o1 * y1 + n1 * x
                    y2 = y2 if y2 == x else o2 * y2 + n2 * x
                    s = (1 - a3) * s + a3 * (y1 - y2)
                since = 0.0
            elif started:
                s = (1 - a3) * s + a3 * (y1 - y2)
            rows.append((y1, y2, y1 - y2, s, y1 - y2 - s) if started else (None,) * 5)
        out = pd.DataFrame(rows, columns=["ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist"], dtype="float64")
        out.insert(0, key, pdf[key].to_numpy())
        out.insert(1, "date", pdf["date"].to_numpy())
        return out

    return kernel


def gap_aware_macd(grid: DataFrame, key: str = "symbol", spans: tuple[int, int, int] = (12, 26, 9),
                   block: int = BLOCK) -> DataFrame:
    """``grid``: key, date, pos (0, 1, … over the calendar of every key) and
    close (NULL in a gap). Key, date, ema_fast, ema_slow, macd, macd_signal and
    macd_hist of every date; NULL before the key's first close."""
    kind = grid.schema[key].dataType
    cut = grid.select(key, "date", "pos", "close", F.floor(F.col("pos") / block).cast("bigint").alias("block"))
    unit = F.concat_ws("\x1f", F.col("block").cast("string"), F.col(key).cast("string"))
    cut = cut.withColumn("unit", unit)
    last = cut.select(F.max("block")).scalar()
    keyed = [T.StructField(key, kind), T.StructField("block", T.LongType())]
    maps = run_by_key(cut.where(F.col("block") < last), "unit", "pos", _block_map(key, spans), T.StructType(keyed + _double(_MAP)))
    states = run_by_key(maps, key, "block", _fold(key, spans), T.StructType(keyed + _double(_STATE)))
    begun = cut.join(states, [key, "block"], "left").fillna(0.0, subset=_STATE)
    return run_by_key(begun, "unit", "pos", _walk(key, spans), T.StructType([
        T.StructField(key, kind), T.StructField("date", T.DateType()),
        *_double(["ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist"])]))


def macd_at_closes(closes: DataFrame, key: str = "symbol", spans: tuple[int, int, int] = (12, 26, 9)) -> DataFrame:
    """``closes``: key, pos (place on the calendar, no two the same; negative:
    without date) and close. The same rows with macd_hist, NULL where the close
    is NaN or has no date. Rows that lie by key already are not exchanged; a task
    holds a batch, not a key."""
    a1, a2, a3 = (2.0 / (s + 1.0) for s in spans)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started, y1, y2, s, at = False, 0.0, 0.0, 0.0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            keys, pos, x = pdf[key].to_numpy(), pdf["pos"].to_numpy(), pdf["close"].to_numpy(dtype="float64")
            begins = pdf["_nth"].to_numpy() == 1
            hist = np.full(len(x), np.nan)
            counts = np.flatnonzero(begins | ((pos >= 0) & (x == x)))
            gaps = np.maximum(np.diff(pos[counts], prepend=at), 1)
            old1, old2, keep = (1.0 - a1) ** gaps, (1.0 - a2) ** gaps, (1.0 - a3) ** (gaps - 1)
            out = []
            for new, p, v, o1, o2, k in zip(begins[counts].tolist(), pos[counts].tolist(), x[counts].tolist(),
                                            old1.tolist(), old2.tolist(), keep.tolist()):
                started = started and not new
                if p < 0 or v != v:                               # a key's first row that is no close of a date
                    out.append(float("nan"))
                    continue
                if started:
                    line = y1 - y2
                    s = line + (s - line) * k
                    y1 = y1 if y1 == v else (o1 * y1 + a1 * v) / (o1 + a1)
                    y2 = y2 if y2 == v else (o2 * y2 + a2 * v) / (o2 + a2)
                    s = (1 - a3) * s + a3 * (y1 - y2)
                else:
                    started, y1, y2, s = True, v, v, 0.0
                out.append(y1 - y2 - s)
            hist[counts] = out
            at = int(pos[counts[-1]]) if len(counts) else at
            yield pd.DataFrame({key: keys, "pos": pos, "close": x, "macd_hist": hist})

    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos"))         # also brings the key's rows together
    rows = closes.select(key, F.col("pos").cast("int").alias("pos"), "close", nth.alias("_nth")).sortWithinPartitions(key, "pos")
    out = rows.mapInPandas(walk, T.StructType([rows.schema[key], T.StructField("pos", T.IntegerType()), *_double(["close", "macd_hist"])]))
    return out.withColumn("macd_hist", F.when(~F.isnan("macd_hist"), F.col("macd_hist")))
