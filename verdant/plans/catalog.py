"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir), reads the whole tables of that folder and
returns a DataFrame whose double columns are rounded to 6 dp (the oracle SQL
rounds the same columns), so results compare value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.plans.oracle import r6, with_ctes
from verdant.session import ship_package
from verdant.sources.tables import Tables

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


# Comparison rounding. Values are rounded to 6 dp on a grid shifted by a small
# constant, so that results with few decimals (exact ties such as 0.6828625)
# never sit on a rounding boundary, where two engines' last-bit differences
# (summation order) would round them apart. The oracle SQL uses the same form.
_GRID_SHIFT = 0.0123


def round_dp(c, digits: int = 6):
    scale = float(10 ** digits)
    return F.round(c * scale + _GRID_SHIFT, 0) / scale


def round_sig(c, digits: int = 8):
    """Round to ``digits`` significant digits, for values whose magnitude makes
    fixed decimals meaningless (compounded growth)."""
    k = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))))
    scale = float(10 ** (digits - 1))
    r = F.round(c / k * scale + _GRID_SHIFT, 0) / scale * k
    return F.when(c.isNull() | (c == 0), c * 0.0).otherwise(r)


def sig_sql(expr: str, alias: str, digits: int = 8) -> str:
    """Oracle twin of ``round_sig``."""
    k = f"pow(10.0e0, floor(log10(abs({expr}))))"
    scale = f"{float(10 ** (digits - 1))!r}e0"
    return (f"case when ({expr}) is null or ({expr}) = 0 then ({expr}) * 0.0e0 "
            f"else round(({expr}) / {k} * {scale} + {_GRID_SHIFT}e0) / {scale} * {k} end as {alias}")


def shift_rounding(sql: str, digits: int = 6) -> str:
    """Rewrite every ``round(X, 6)`` of an oracle statement into the shifted
    grid form used by ``round_dp``."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 0, j + len(key), -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        arg = sql[j + len(key):comma] if comma > 0 else None
        if comma > 0 and sql[comma + 1:k].strip() == str(digits):
            inner = shift_rounding(arg, digits)
            scale = f"{float(10 ** digits)!r}e0"
            out.append(sql[i:j])
            out.append(f"(round(({inner}) * {scale} + {_GRID_SHIFT}e0) / {scale})")
            i = k + 1
        else:
            out.append(sql[i:j + len(key)])
            i = j + len(key)


def finish(df: DataFrame, digits: int = 6, sig: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles, widen small integers to bigint (the oracle's types)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double")
            c = round_sig(c) if f.name in sig else round_dp(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None, sig: tuple[str, ...] = ()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return finish(fn(Tables(spark, sf_dir)), sig=sig)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, shift_rounding(with_ctes(sql)) if sql else None)
        return run
    return deco


def sel(*cols: str, doubles: tuple[str, ...] = ()) -> str:
    """Select list for the oracle: doubles rounded, others as is."""
    return ", ".join(r6(c) if c.split(".")[-1] in doubles else c for c in cols)
