"""Rounding, clamping and truthiness helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(col: Column, digits: int) -> Column:
    """HALF_UP rounding that ignores float noise below 1e-10.

    Sums of doubles depend on the order partial aggregates meet, so the noise
    is removed before the visible digits are cut.
    """
    return F.round(F.round(col, 10), digits)


def clamp(col: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(col, F.lit(high)), F.lit(low))


def first_truthy_text(*cols: Column) -> Column:
    """First column that is neither null nor the empty string (an ``or`` chain over text)."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def first_truthy_number(*cols: Column) -> Column:
    """First column that is neither null nor zero (an ``or`` chain over numbers)."""
    return F.coalesce(*[F.when(c != 0, c) for c in cols])


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def round_half_even(col: Column) -> Column:
    """Nearest integer with ties to even, as a bigint."""
    return F.bround(col, 0).cast("bigint")
