"""Arithmetic with the reference's rules for division, remainder and special values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column) -> Column:
    """Whole-number division rounding down; null for a zero divisor."""
    zero = F.lit(0)
    return F.floor(a / F.nullif(b, zero)).cast("bigint")


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    d = F.nullif(b, F.lit(0))
    return a - F.floor(a / d) * d


def true_div(a: Column, b: Column) -> Column:
    """Division on doubles: 0/0 is NaN and x/0 is an infinity."""
    x, y = a.cast("double"), b.cast("double")
    special = (F.when((x == 0) | F.isnan(x), F.lit(float("nan")))
               .when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, special).otherwise(F.try_divide(x, y))


def fold(start: Column, step: Callable[[Column, Column], Column], columns: list[Column]) -> Column:
    return reduce(step, columns, start)


def sum_across(columns: list[Column]) -> Column:
    """Row-wise sum; nulls count as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def all_across(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
