"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_round(c: Column | str, digits: int) -> Column:
    """Round to ``digits`` decimals as round(x · 10^d) / 10^d, halves away from
    zero on the scaled binary value. This is the rounding of report fields
    (weights to 4 dp, Sharpe to 3 dp, …); it is defined on the binary value so
    it does not depend on how a double prints."""
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.round(col * scale, 0) / scale
