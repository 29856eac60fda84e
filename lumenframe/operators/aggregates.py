"""Aggregates that need more than one call of a Spark function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..selectors import numeric
from .ordering import join_back, number_rows

def sum_or_zero(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def n_unique(c: Column) -> Column:
    """Exact distinct count in which null is one value."""
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def value_counts(df: DataFrame, name: str, count: str = "count") -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias(count))


def first_seen(df: DataFrame, keys: list[str], row_key: str, **aggregates: Column) -> DataFrame:
    """Groups with the smallest row key, by which first-seen order can be restored."""
    return df.groupBy(*keys).agg(F.min(row_key).alias("first_row"), *[c.alias(n) for n, c in aggregates.items()])


def list_positions(df: DataFrame, keys: list[str], order: str, tie: str | None = None, *, name: str = "position",
                   bounds_from: DataFrame | None = None) -> DataFrame:
    """The lists of groups in long form: each row with its place in the list of its key.

    This form has no limit: the rows of a hot key stay spread over many tasks.
    """
    return number_rows(df, name, order, tie, keys, bounds_from=bounds_from)


def collect_lists(df: DataFrame, keys: list[str], value: str, order: str, tie: str | None = None, *,
                  name: str | None = None) -> DataFrame:
    """The ordered values of each group as one list, nulls kept.

    A list is one cell, so a group must fit one; `list_positions` is the form for groups
    of any size. Values with equal order and tie come in the order of the values.
    """
    at = [F.col(f"`{order}`").alias("o")] + ([F.col(f"`{tie}`").alias("t")] if tie else [])
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.struct(c.isNull(), c).alias(f"k{i}") for i, c in enumerate(at)], F.col(f"`{value}`").alias("v")))).alias("_l"))
    return lists.select(*keys, F.transform("_l", lambda x: x["v"]).alias(name or value))


def lists_on_rows(df: DataFrame, keys: list[str], value: str, order: str, tie: str | None = None, *,
                  name: str = "values") -> DataFrame:
    """Each row with the list of its group: the size of the result is the sum of the
    squared group sizes, by its meaning."""
    return join_back(df, collect_lists(df, keys, value, order, tie, name=name), keys, "inner")


def describe(df: DataFrame) -> DataFrame:
    """count, null_count, mean, std, min and max of each numeric column, in one pass."""
    names = numeric().names(df)
    aggs = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        aggs += [
            F.struct(
                F.lit(n).alias("column"), F.count(c).alias("count"), F.count_if(c.isNull()).alias("null_count"),
                F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            ).alias(f"s{i}")
        ]
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(names))])).alias("s")).select("s.*")


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def duplicated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which the key values appear more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return join_back(df, many, keys, "left_semi")


def first_rows_of_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows per key; Spark cuts each task's input to n per key before the
    shuffle, so a hot key stays small."""

    return (df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col("_rn") <= n).drop("_rn"))


