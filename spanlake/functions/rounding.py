"""Decimal rounding of binary doubles by their true value, ties to even.

Spark's ``round`` rounds the shortest decimal text of a double half up, so 2.675 becomes 2.68 although
the stored number is below the tie. Here the distance to the tie is computed without error: the input
is split into two halves whose products with the scale are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1


def round_true(x: Column | str, digits: int) -> Column:
    if isinstance(x, str):  # a column name: one expression instead of a tree built call by call
        return F.expr(round_true_sql(f"`{x}`", digits))
    scale = float(10 ** digits)
    big = x * F.lit(_SPLITTER)
    high = big - (big - x)
    low = x - high
    k = F.floor(x * F.lit(scale)).cast("double")
    side = (high * F.lit(2 * scale) - (k * 2 + 1)) + low * F.lit(2 * scale)
    up = (side > 0) | ((side == 0) & (F.pmod(k, F.lit(2.0)) == 1))
    return (k + up.cast("double")) / F.lit(scale)


def round_true_sql(x: str, digits: int) -> str:
    """The same arithmetic as SQL text that Spark and other engines read alike; ``x`` should be a plain
    column name."""
    s = f"CAST({10 ** digits} AS DOUBLE)"
    split = "CAST(134217729 AS DOUBLE)"
    high = f"({x}*{split}-({x}*{split}-{x}))"
    k = f"floor({x}*{s})"
    side = f"(({high}*2*{s}-({k}*2+1))+({x}-{high})*2*{s})"
    return (f"(({k}+CASE WHEN {side}>0 OR ({side}=0 AND {k}%2<>0) THEN 1 ELSE 0 END)/{s})")
