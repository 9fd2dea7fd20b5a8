"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

__all__ = ["mm_per_hr_to_m_per_s", "manning_default", "yieldstep", "doubling_bands",
           "target_triangle_area", "rounded"]


def mm_per_hr_to_m_per_s(rate: Column) -> Column:
    return rate * F.lit(S.RAINFALL_FACTOR)


def manning_default(value: Column) -> Column:
    return F.coalesce(value, F.lit(S.DEFAULT_MANNINGS_N))


def yieldstep(duration: Column) -> Column:
    """A hundredth of the duration in whole seconds, held between 60 and 1800."""
    share = F.floor(duration / F.lit(S.MAX_YIELD_STEPS))
    return F.least(F.greatest(share, F.lit(S.MIN_YIELD_STEP_S)), F.lit(S.MAX_YIELD_STEP_S)).cast("bigint")


def doubling_bands(near: Column, far: Column) -> Column:
    """near, 2·near, 4·near … while below far; empty when near is not below far."""
    doubled = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: near * F.pow(F.lit(2.0), i))
    return F.filter(doubled, lambda d: d < far)


def target_triangle_area(spacing: Column) -> Column:
    """Area of the equilateral triangle with the given side."""
    return spacing * spacing * F.lit(3.0 ** 0.5 / 4.0)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison, with negative zero folded into zero."""
    return F.round(value, digits) + F.lit(0.0)
