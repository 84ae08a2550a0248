"""Operator 13 — periodic run detection by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q, at least
``least`` words and ``times`` periods long, that no neighbouring word extends.
Every word of a run occurs ``times`` times or more inside it, hence also inside
any segment that holds the run. So a text starts as one segment; words that
occur too rarely in their segment split it, pieces shorter than ``least`` go,
and what changed is looked at again until no segment changes. A run lies whole
in one of the segments that are left, and only these are scanned lag by lag:
up to ``FULL_LAGS`` by comparing all words with those one lag on, beyond that
by the hashes of neighbouring blocks one lag long (a run holds two equal whole
blocks), each hit extended and compared word by word. A stretch inside a found
run whose period divides the lag has that smaller period and is no run.

Splitting treats all texts of an Arrow batch at once; one text is held whole
in one task (its words and a few integers for each), never a group of texts.
Splitting costs a sort per round, the scan of a segment of m words about
m log m steps.

Defined cases: a null or empty text, or one of white space, has no runs and an
empty collapsed text; runs may overlap; repeated rows and rows without id are
treated like all others; all columns pass through, and ``runs`` and
``collapsed`` get underscores where such a column is there already. In the
registered query a null doc_id has no checksum, so its text stays as it is.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from verdant.llm.common import arrow_map, fresh

LEAST, TIMES = 24, 3
FULL_LAGS = 16                # more than half of LEAST: longer blocks of a smaller period lie in a run of it
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_RUN = StructType([StructField(k, LongType()) for k in ("start", "length", "period")])
_RUN_ARROW = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])


def stable_segments(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """The segments that are left of ``[begin, end)`` when no word is too rare in its own."""
    kinds = int(ids.max()) + 1 if len(ids) else 1
    left: list[tuple[int, int]] = []
    while True:
        long = end - begin >= least
        begin, end = begin[long], end[long]
        if not len(begin):
            return sorted(left)
        lens = end - begin
        first = np.cumsum(lens) - lens
        segment = np.repeat(np.arange(len(begin)), lens)
        at = np.arange(int(lens.sum())) + np.repeat(begin - first, lens)
        _, which, count = np.unique(segment * kinds + ids[at], return_inverse=True, return_counts=True)
        often = count[which] >= times
        whole = np.logical_and.reduceat(often, first)
        left += zip(begin[whole].tolist(), end[whole].tolist())
        often &= ~whole[segment]
        opens, closes = often.copy(), often.copy()
        opens[1:] &= ~often[:-1] | (segment[1:] != segment[:-1])
        closes[:-1] &= ~often[1:] | (segment[1:] != segment[:-1])
        begin, end = at[opens], at[closes] + 1


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of True."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Found:
    """Runs found so far, by period; those of one period never contain each other."""

    def __init__(self) -> None:
        self.by_period: dict[int, tuple[list[int], list[int]]] = {}

    def covers(self, lag: int, begin: int, end: int) -> bool:
        for period, (begins, ends) in self.by_period.items():
            if lag % period == 0:
                k = bisect_right(begins, begin) - 1
                if k >= 0 and ends[k] >= end:
                    return True
        return False

    def add(self, period: int, begin: int, end: int) -> None:
        begins, ends = self.by_period.setdefault(period, ([], []))
        begins.append(begin)
        ends.append(end)


def scan(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the word numbers ``x``, by start and period."""
    n = len(x)
    found = _Found()

    def compare(lag: int) -> None:
        begins, ends = _stretches(x[:-lag] == x[lag:])
        wide = ends - begins >= max(least, times * lag) - lag
        for b, e in zip(begins[wide].tolist(), (ends[wide] + lag).tolist()):
            if not found.covers(lag, b, e):
                found.add(lag, b, e)

    few = max(FULL_LAGS, least // 2)
    for lag in range(1, min(few, n // times) + 1):
        compare(lag)
    if n // times > few:
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, _BASE, np.uint64))
            value = (x.astype(np.uint64) + _U(1)) * _U(0xBF58476D1CE4E5B9)
            total = np.append(_U(0), np.cumsum((value ^ (value >> _U(29))) * power))
            for lag in range(few + 1, n // times + 1):
                block = np.diff(total[::lag])
                hits = block[:-1] * power[lag - 1] == block[1:]
                if not hits.any():
                    continue
                spans = list(zip(*(e.tolist() for e in _stretches(hits))))
                for k, stop in spans:
                    b, e = k * lag, (stop + 1) * lag
                    if found.covers(lag, b, e):
                        continue
                    if not np.array_equal(x[b:e - lag], x[b + lag:e]):       # equal hashes of unequal blocks
                        found.by_period.pop(lag, None)
                        compare(lag)
                        break
                    back = x[max(0, b - lag):b][::-1] == x[max(0, b - lag) + lag:b + lag][::-1]
                    on = x[e - lag:min(n, e + lag) - lag] == x[e:min(n, e + lag)]
                    b -= int(back.argmin()) if not back.all() else len(back)
                    e += int(on.argmin()) if not on.all() else len(on)
                    if e - b >= max(least, times * lag) and not found.covers(lag, b, e):
                        found.add(lag, b, e)
    return sorted((b, e - b, p) for p, (begins, ends) in found.by_period.items() for b, e in zip(begins, ends))


def runs_of(texts: list[str | None], least: int = LEAST, times: int = TIMES) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """Words and runs of every text."""
    words = [t.encode().split() if t else [] for t in texts]           # on \x20 and \x09-\x0D alone
    number: dict[bytes, int] = {}
    long = [i for i, w in enumerate(words) if len(w) >= least]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not long:
        return words, runs
    ids = np.fromiter((number.setdefault(w, len(number)) for i in long for w in words[i]), np.int64)
    lens = np.array([len(words[i]) for i in long])
    end = np.cumsum(lens)
    begin = end - lens
    for b, e in stable_segments(ids, begin, end, least, times):
        k = bisect_right(begin, b) - 1
        runs[long[k]] += [(b - int(begin[k]) + s, n, p) for s, n, p in scan(ids[b:e], least, times)]
    return words, runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words outside all runs and of every run's first period, joined by a space."""
    if not runs:
        return b" ".join(words).decode()
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]).decode()


def find(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, the text with each run cut to its first period."""
    if times < 3 or least < 1:                # two periods alone need not hold two whole blocks of a lag
        raise ValueError("a run has at least three periods and one word")
    runs_col = fresh(docs.columns, "runs")
    collapsed_col = fresh([*docs.columns, runs_col], "collapsed")
    place, names = docs.columns.index(text_col), [*docs.columns, runs_col, collapsed_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, runs = runs_of(b.column(place).to_pylist(), least, times)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(_RUN_ARROW)),
                 pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.string())],
                names=names)

    return arrow_map(docs, run, StructType([*docs.schema.fields, StructField(runs_col, ArrayType(_RUN)),
                                            StructField(collapsed_col, StringType())]))


def with_periods(doc_id: Column, text: Column) -> Column:
    """The contract's text: of a document whose checksum ends in 0, the words
    from one on repeat a period that its checksum names."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, F.get(changed, F.lit(0))).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (start, length,
    period, exponent_milli; null without runs), runs_sha256, collapsed_sha256."""
    texts = docs.select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text"))
    found = find(texts)
    more = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                  F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return (found.withColumn("best", F.reduce("runs", F.get("runs", F.lit(0)), more))
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
