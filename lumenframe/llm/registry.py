"""Registration of this subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a function of (spark, data folder) under a key."""
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(prepare(spark), root)

        QUERIES[key] = run
        if oracle:
            ORACLES[key] = oracle.strip()
        return run
    return register


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")
