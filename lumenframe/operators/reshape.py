"""Concatenation, pivots and list or struct reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import number_rows


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Row union of frames with the same column names and types."""
    shape = [(f.name, f.dataType) for f in frames[0].schema.fields]
    for other in frames[1:]:
        if [(f.name, f.dataType) for f in other.schema.fields] != shape:
            raise ValueError("frames differ in column names, order or types")
    out = frames[0]
    for other in frames[1:]:
        out = out.union(other)
    return out


def stack_diagonal(*frames: DataFrame) -> DataFrame:
    """Row union on the union of columns, gaps null."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def side_by_side(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Columns of both frames by row position; the shorter one is padded with nulls."""
    a = number_rows(left, "_row", left_order)
    b = number_rows(right, "_row", right_order)
    return a.join(b, "_row", "full").drop("_row")


def pivot(df: DataFrame, index: list[str], on: str, value: Column, values: list | None = None, prefix: str = "") -> DataFrame:
    """One column per value of `on`. Without `values` Spark reads them first."""
    wide = df.groupBy(*index).pivot(on, values).agg(value)
    made = [c for c in wide.columns if c not in index]
    return wide.select(*index, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in made])


def unpivot(df: DataFrame, index: list[str], on: list[str]) -> DataFrame:
    return df.unpivot(index, on, "variable", "value")


def explode_lists(df: DataFrame, *names: str) -> DataFrame:
    """Lists to rows, several side by side; an empty list gives one null row."""
    others = [c for c in df.columns if c not in names]
    if len(names) == 1:
        return df.select(*others, F.explode_outer(names[0]).alias(names[0]))
    zipped = F.arrays_zip(*[F.col(n) for n in names])
    return df.select(*others, F.explode_outer(zipped).alias("_z")).select(*others, *[F.col(f"_z.{n}").alias(n) for n in names])


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a plain computed column is pushed below it and computes it again, as
    often as it is named. A generated column stops that: worth it for parsed JSON.
    """
    others = [c for c in df.columns if c not in columns]
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in others], F.inline(F.array(packed)))
