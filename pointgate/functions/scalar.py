"""Scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int) -> Column:
    """``floor(c * 10**digits + 0.5) / 10**digits``: the same binary steps in any engine.

    ``round`` works on decimal text in one engine and on binary values in another, and they part
    at ties such as 2.675; values that are compared across engines are rounded by this.
    """
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def half_even(c: Column, digits: int) -> Column:
    """``round`` of Python: to the nearest by the exact binary value of ``c``, ties to even.

    ``c * 10**digits`` is taken exactly as a product and its error (Dekker), so that 2.675, which lies
    just below its decimal text, gives 2.67.  For values up to 2**53 / 10**digits.
    """
    scale = float(10**digits)
    high = lambda x: (x * 134217729.0) - ((x * 134217729.0) - x)
    s1 = (scale * 134217729.0) - ((scale * 134217729.0) - scale)
    s2 = scale - s1
    a = F.abs(c)
    p, a1 = a * scale, high(a)
    a2 = a - a1
    error = ((a1 * s1 - p) + a1 * s2 + a2 * s1) + a2 * s2
    low = F.floor(p).cast("double")
    over = ((p - low) - 0.5) + error
    up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2.0)) == 1))
    return F.signum(c) * (low + F.when(up, 1.0).otherwise(0.0)) / scale


def half_even_sql(x: str, digits: int) -> str:
    """The same in SQL, for a column or a constant ``x``."""
    scale = float(10**digits)
    s1 = (scale * 134217729.0) - ((scale * 134217729.0) - scale)
    s2 = scale - s1
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    a = f"abs({x})"
    p, a1 = f"({a} * {d(scale)})", f"(({a} * {d(134217729.0)}) - (({a} * {d(134217729.0)}) - {a}))"
    a2 = f"({a} - {a1})"
    over = f"((({p} - floor({p})) - 0.5::DOUBLE) + ((({a1} * {d(s1)} - {p}) + {a1} * {d(s2)} + {a2} * {d(s1)}) + {a2} * {d(s2)}))"
    return f"(sign({x}) * (floor({p}) + CASE WHEN {over} > 0 OR ({over} = 0 AND floor({p}) % 2 = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / {d(scale)})"
