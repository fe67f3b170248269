"""Rounding, rates and ranks with fixed semantics (halves round up; a rate over nothing is null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def rate_pct(n: Column, d: Column) -> Column:
    """Percent with two decimals; null over zero."""
    return F.when(d > 0, F.floor(n / d * F.lit(10000.0) + F.lit(0.5)) / F.lit(100.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def money(x: Column, digits: int = 4) -> Column:
    """A decimal, so that sums do not depend on the order of addition."""
    return x.cast(f"decimal(18,{digits})")


def efficiency(x: Column, full: float, zero: float) -> Column:
    """1 up to full, 0 from zero on, linear between; null for null."""
    return F.when(x <= full, F.lit(1.0)).when(x >= zero, F.lit(0.0)).otherwise((F.lit(float(zero)) - x) / F.lit(float(zero - full)))
