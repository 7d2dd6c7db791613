"""Rates and means with exact decimal rounding (half away from zero)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, total: Column, scale: int) -> Column:
    """``part`` as a percentage of ``total``; a total below one counts as one.

    Decimals only: binary floating point would turn 28.75 into 28.7.
    """
    share = F.coalesce(part, F.lit(0)).cast("decimal(20,0)") / F.greatest(total, F.lit(1))
    return F.round(share * 100, scale).cast(f"decimal(20,{scale})")


def mean(units: Column, count: Column, scale: int) -> Column:
    """Mean to one digit after the point; NULL when nothing was counted.

    ``units`` is the sum in whole units of 10^-``scale``. Whole numbers are divided
    after half the divisor is added, so no second rounding can occur.
    """
    divisor = F.nullif(count, F.lit(0)) * F.lit(Decimal(10 ** (scale - 1)))
    tenths = F.call_function("div", F.abs(units) * 2 + divisor, divisor * 2)
    signed = F.when(units < 0, -tenths).otherwise(tenths)
    return (signed.cast("decimal(20,0)") / 10).cast("decimal(10,1)")
