"""Column sets resolved against a schema before the plan is built."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


class Selector:
    """A set of columns, closed under union, difference, intersection and complement.

    Work is on schema fields only, so a selector costs nothing at run time.
    """

    def __init__(self, pick: Callable[[list[T.StructField]], set[str]]):
        self._pick = pick

    def names(self, df: DataFrame) -> list[str]:
        chosen = self._pick(list(df.schema.fields))
        return [n for n in df.columns if n in chosen]

    def columns(self, df: DataFrame) -> list[Column]:
        return [F.col(f"`{n}`") for n in self.names(df)]

    def apply(self, df: DataFrame, fn: Callable[[Column], Column], prefix: str = "", suffix: str = "") -> list[Column]:
        return [fn(F.col(f"`{n}`")).alias(f"{prefix}{n}{suffix}") for n in self.names(df)]

    def negated(self, df: DataFrame) -> list[Column]:
        """The values negated, as opposed to `~`, which picks the other columns."""
        return self.apply(df, lambda c: ~c)

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda f: self._pick(f) | other._pick(f))

    def __and__(self, other: Selector) -> Selector:
        return Selector(lambda f: self._pick(f) & other._pick(f))

    def __sub__(self, other: Selector) -> Selector:
        return Selector(lambda f: self._pick(f) - other._pick(f))

    def __invert__(self) -> Selector:
        return Selector(lambda f: {x.name for x in f} - self._pick(f))


def _where(test: Callable[[T.StructField], bool]) -> Selector:
    return Selector(lambda fields: {f.name for f in fields if test(f)})


def all_columns() -> Selector:
    return _where(lambda f: True)


def by_dtype(*kinds: type[T.DataType]) -> Selector:
    return _where(lambda f: isinstance(f.dataType, kinds))


def integer() -> Selector:
    return by_dtype(*INTEGERS)


def floating() -> Selector:
    return by_dtype(T.FloatType, T.DoubleType)


def numeric() -> Selector:
    return by_dtype(T.NumericType)


def string() -> Selector:
    return by_dtype(T.StringType)


def temporal() -> Selector:
    return by_dtype(*TEMPORAL)


def boolean() -> Selector:
    return by_dtype(T.BooleanType)


def first() -> Selector:
    return Selector(lambda fields: {fields[0].name} if fields else set())


def last() -> Selector:
    return Selector(lambda fields: {fields[-1].name} if fields else set())


def by_name(*names: str) -> Selector:
    return _where(lambda f: f.name in names)


def matches(pattern: str) -> Selector:
    return _where(lambda f: re.search(pattern, f.name) is not None)


def contains(text: str) -> Selector:
    return _where(lambda f: text in f.name)


def starts_with(*texts: str) -> Selector:
    return _where(lambda f: f.name.startswith(texts))


def ends_with(*texts: str) -> Selector:
    return _where(lambda f: f.name.endswith(texts))
