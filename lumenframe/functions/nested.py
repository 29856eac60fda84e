"""Lists, fixed-size arrays, structs and ordered categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_slice(c: Column, offset: int, length: int | None = None) -> Column:
    """Items from an offset, counted from the end when negative; the start is held
    inside the list."""
    size = F.size(c)
    start = F.lit(offset) if offset >= 0 else size + F.lit(offset)
    stop = size if length is None else F.least(start + F.lit(length), size)
    first = F.greatest(start, F.lit(0))
    return F.slice(c, first + 1, F.greatest(stop - first, F.lit(0)))


def list_head(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def list_tail(c: Column, n: int) -> Column:
    return list_slice(c, -n, n)


def count_items(c: Column, test) -> Column:
    return F.size(F.filter(c, test)).cast("bigint")


def not_whole_number(c: Column) -> Column:
    """Whether a text does not cast to a bigint. The pattern goes first: a failed cast
    is far slower than a failed match."""
    return ~c.rlike(r"^[\s\x00-\x1F]*[+-]?[0-9]+[\s\x00-\x1F]*\z") | c.try_cast("bigint").isNull()


def list_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def entropy(c: Column) -> Column:
    """Natural-log entropy of the items as shares of their sum t: ln t - sum(x ln x) / t."""
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s"))
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    term = lambda x: F.when(number(x) > 0, number(x) * F.ln(number(x))).otherwise(F.lit(0.0))
    step = lambda a, x: F.struct((a["t"] + number(x)).alias("t"), (a["s"] + term(x)).alias("s"))
    return F.aggregate(c, start, step, lambda a: F.when(a["t"] > 0, F.ln(a["t"]) - F.try_divide(a["s"], a["t"])))


def rank_share(c: Column, digits: int = 2) -> Column:
    """Descending average rank of each item over the list size.

    Meant for short lists (columns turned into a list): it compares all items.
    """
    n = F.size(c)
    above = lambda x: F.size(F.filter(c, lambda y: y > x))
    same = lambda x: F.size(F.filter(c, lambda y: y == x))
    return F.transform(c, lambda x: F.round((above(x) + (same(x) + 1) / 2) / n, digits))


def sort_by_field(c: Column, field: str, tie: str | None = None, descending: bool = False) -> Column:
    """A list of structs ordered by a field."""
    keyed = F.transform(c, lambda x: F.struct(x[field].alias("k"), *([x[tie].alias("t")] if tie else []), x.alias("v")))
    return F.transform(F.sort_array(keyed, not descending), lambda x: x["v"])


def fixed_size(c: Column, n: int) -> Column:
    """The list where it has exactly n items, an error otherwise."""
    return F.when(c.isNull() | (F.size(c) == n), c).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n} items, got "), F.size(c).cast("string"))))


def rename_fields(c: Column, names: list[str], types: list[str]) -> Column:
    return c.cast("struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, types, strict=True)) + ">")


def ordinal(c: Column, domain: list[str]) -> Column:
    """Position of a value in its ordered domain, from 1; 0 for a foreign value."""
    return F.array_position(F.array(*[F.lit(d) for d in domain]), c)


def in_domain(c: Column, domain: list[str]) -> Column:
    return c.isNull() | c.isin(*domain)


def checked(c: Column, domain: list[str]) -> Column:
    """The value, or an error where it is not of the domain."""
    return F.when(in_domain(c, domain), c).otherwise(F.raise_error(F.concat(F.lit("not in the domain: "), c)))
