"""Caller-given Python functions, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import with_group_statistics, with_statistics


def map_values(fn: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of one or more columns over whole batches."""
    return F.pandas_udf(fn, returns)


def map_column(df: DataFrame, fn: Callable[..., pd.Series], returns: str, name: str, column: str,
               **statistics: Column) -> DataFrame:
    """A function that needs to see the whole column, in two passes: what it needs of
    the column as aggregates, then batches of values with those beside them."""
    wide = with_statistics(df, **statistics)
    return wide.withColumn(name, F.pandas_udf(fn, returns)(F.col(column), *[F.col(s) for s in statistics])).drop(*statistics)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[..., pd.Series], returns: str, name: str, column: str,
               **statistics: Column) -> DataFrame:
    """The same per group. No task needs a whole group, so a hot key is no limit."""
    wide = with_group_statistics(df, keys, **statistics)
    return wide.withColumn(name, F.pandas_udf(fn, returns)(F.col(column), *[F.col(s) for s in statistics])).drop(*statistics)


def batch_generate(df: DataFrame, fn: Callable[[list[str]], list[str]], prompt: str, response: str, batch: int = 128) -> DataFrame:
    """Fixed-size batches of prompts through a caller-given function.

    Input columns are kept; a batch with another number of answers is an error.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(response, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                piece = frame.iloc[start:start + batch]
                answers = fn(piece[prompt].tolist())
                if len(answers) != len(piece):
                    raise RuntimeError(f"{len(answers)} answers for {len(piece)} prompts")
                yield piece.assign(**{response: answers})

    return df.mapInPandas(run, schema)
