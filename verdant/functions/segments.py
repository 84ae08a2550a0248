"""Mergeable risk state of a stretch of prices (E1–E9 without the stretch's rows).

``segment_states`` reduces the closes of each (key, segment) to one struct;
``combine`` joins the states of two neighbouring stretches, the earlier first,
and is associative, so a key's whole history is a fold over its segments in
date order, however it is cut. ``metric_columns`` reads the measures of
``functions.risk`` off a state.

The state holds the number of closes, first, lowest, highest and last one, the
deepest drawdown and the same without the stretch's first price (E6 starts
there), count, mean and squared deviations of the returns and of the losing
ones, and the last closes that momentum looks back to. Means and squared
deviations merge pairwise, which does not cancel the way plain sums of squares do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.functions import risk

TAIL = 61                     # closes a momentum of 60 rows looks at
STATE = ("struct<n:bigint,first:double,low:double,peak:double,last:double,mdd:double,peak_ex:double,mdd_ex:double,"
         "r:struct<n:bigint,mean:double,m2:double>,d:struct<n:bigint,mean:double,m2:double>,tail:array<double>>")


def _moments(x: Column) -> Column:
    n = F.count(x)
    return F.struct(n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
                    F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2"))


def _joined(a: Column, b: Column) -> Column:
    """Moments of two samples together."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    share = F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
    return F.struct(n.alias("n"), F.when(a["n"] == 0, b["mean"]).otherwise(a["mean"] + apart * share).alias("mean"),
                    (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))


def _one(x: Column, counts: Column) -> Column:
    """Moments of the single value ``x``, or of none."""
    return F.struct(F.when(counts, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("n"),
                    F.when(counts, x).otherwise(F.lit(0.0)).alias("mean"), F.lit(0.0).alias("m2"))


def _below(low: Column, peak: Column) -> Column:
    return F.try_divide(low - peak, peak)


def segment_states(prices: DataFrame, keys: list[str], order: str = "date", price: str = "close") -> DataFrame:
    """``keys`` and ``state`` of every group's closes (NULL closes do not
    count); one exchange by ``keys``, a group being one stretch."""
    w = Window.partitionBy(*keys).orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = prices.where(F.col(price).isNotNull()).select(
        *keys, order, F.col(price).alias("close"), F.row_number().over(w).alias("rn"),
        (F.try_divide(F.col(price), F.lag(price).over(w)) - 1).alias("ret"), F.max(price).over(running).alias("peak"))
    p = p.withColumn("peak_ex", F.max(F.when(F.col("rn") > 1, F.col("close"))).over(running))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "close"))), lambda x: x["close"])
    state = F.struct(
        F.count(F.lit(1)).alias("n"), F.min_by("close", "rn").alias("first"), F.min("close").alias("low"),
        F.max("close").alias("peak"), F.max_by("close", "rn").alias("last"), F.min(_below(F.col("close"), F.col("peak"))).alias("mdd"),
        F.max("peak_ex").alias("peak_ex"), F.min(_below(F.col("close"), F.col("peak_ex"))).alias("mdd_ex"),
        _moments(F.col("ret")).alias("r"), _moments(F.when(F.col("ret") < 0, F.col("ret"))).alias("d"),
        F.slice(ordered, -F.least(F.lit(TAIL), F.count(F.lit(1))).cast("int"), TAIL).alias("tail"))
    return p.groupBy(*keys).agg(state.cast(STATE).alias("state"))


def combine(a: Column, b: Column) -> Column:
    """The state of stretch ``a`` and the stretch ``b`` after it (NULL: no stretch)."""
    step = F.try_divide(b["first"], a["last"]) - 1
    tail = F.concat(a["tail"], b["tail"])
    both = F.struct(
        (a["n"] + b["n"]).alias("n"), a["first"].alias("first"), F.least(a["low"], b["low"]).alias("low"),
        F.greatest(a["peak"], b["peak"]).alias("peak"), b["last"].alias("last"),
        F.least(a["mdd"], b["mdd"], _below(b["low"], a["peak"])).alias("mdd"),          # p / max(P, M) is the lesser of p/P and p/M
        F.greatest(a["peak_ex"], b["peak"]).alias("peak_ex"),
        F.least(a["mdd_ex"], b["mdd"], _below(b["low"], a["peak_ex"])).alias("mdd_ex"),
        _joined(_joined(a["r"], _one(step, step.isNotNull())), b["r"]).alias("r"),
        _joined(_joined(a["d"], _one(step, F.coalesce(step < 0, F.lit(False)))), b["d"]).alias("d"),
        F.slice(tail, -F.least(F.lit(TAIL), F.size(tail)), TAIL).alias("tail")).cast(STATE)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def fold(states: Column) -> Column:
    """The state of an array of stretches in date order."""
    return F.reduce(states, F.lit(None).cast(STATE), combine)


def _std(m: Column) -> Column:
    return F.when(m["n"] > 1, F.sqrt(m["m2"] / (m["n"] - 1)))


def metric_columns(state: Column, min_returns: int) -> dict[str, Column]:
    """The measures E2–E9 as ``functions.risk`` defines them, by name, with the
    numbers of closes and returns; NULL below ``min_returns`` returns."""
    r, d, n = state["r"], state["d"], state["n"]
    sd, down = _std(r), _std(d)
    total = F.try_divide(state["last"], state["first"]) - 1
    annual = (F.when(n <= 1, F.lit(0.0)).when(total <= -1, F.lit(0.0))
              .otherwise(F.pow(1 + total, F.try_divide(F.lit(float(risk.TRADING_DAYS)), n - 1)) - 1))

    def back(k: int) -> Column:
        before = F.get(state["tail"], F.size(state["tail"]) - 1 - k)
        return F.when(n < k + 1, F.lit(0.0)).otherwise(F.try_divide(state["last"] - before, before))

    out = {
        "annual_return": annual,
        "annual_volatility": F.when(r["n"] == 0, F.lit(0.0)).otherwise(sd * risk.SQRT_TRADING_DAYS),
        "sharpe_252d": F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(r["mean"], sd) * risk.SQRT_TRADING_DAYS),
        "sortino_252d": F.when((d["n"] == 0) | (down == 0), F.lit(0.0)).otherwise(F.try_divide(r["mean"], down) * risk.SQRT_TRADING_DAYS),
        "calmar_ratio": risk.calmar(annual, F.coalesce(state["mdd_ex"], F.lit(0.0))),
        "max_drawdown": F.coalesce(state["mdd"], F.lit(0.0)),
        "momentum_20d": back(20),
        "momentum_60d": back(60),
    }
    enough = r["n"] >= min_returns
    return {"n_closes": n, "n_returns": r["n"]} | {k: F.when(enough, c) for k, c in out.items()}
