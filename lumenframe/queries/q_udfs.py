"""Caller-given functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import grouped as g
from ..session import table
from .registry import query


@query("udf_scalar", "SELECT p_partkey, round(ln(p_retailprice), 9) AS log_price, round(ln(p_retailprice), 9) AS native FROM part")
def udf_scalar(spark, root):
    def log(v: pd.Series) -> pd.Series:
        return np.log(v)
    p = table(spark, root, "part")
    return p.select("p_partkey", F.round(g.map_values(log, "double")("p_retailprice"), 9).alias("log_price"),
                    F.round(F.ln("p_retailprice"), 9).alias("native"))


@query("udf_batch", "SELECT p_partkey, round(p_retailprice - (SELECT avg(p_retailprice) FROM part), 6) AS off_mean FROM part")
def udf_batch(spark, root):
    def off(v: pd.Series, mean: pd.Series) -> pd.Series:
        return v - mean
    p = table(spark, root, "part").select("p_partkey", "p_retailprice")
    return g.map_column(p, off, "double", "off_mean", "p_retailprice", mean=F.avg("p_retailprice")).select(
        "p_partkey", F.round("off_mean", 6).alias("off_mean"))


@query("udf_grouped", """
SELECT p_partkey, p_brand, round(p_size - avg(p_size) OVER (PARTITION BY p_brand), 6) AS off_mean FROM part""")
def udf_grouped(spark, root):
    def off(v: pd.Series, mean: pd.Series) -> pd.Series:
        return v - mean
    p = table(spark, root, "part").select("p_partkey", "p_brand", "p_size")
    made = g.map_groups(p, ["p_brand"], off, "double", "off_mean", "p_size", mean=F.avg("p_size"))
    return made.select("p_partkey", "p_brand", F.round("off_mean", 6).alias("off_mean"))


@query("udf_two_columns", "SELECT p_partkey, CAST(length(p_name) + p_size AS BIGINT) AS both FROM part")
def udf_two_columns(spark, root):
    def add(name: pd.Series, size: pd.Series) -> pd.Series:
        return name.str.len() + size
    return table(spark, root, "part").select("p_partkey", g.map_values(add, "bigint")("p_name", "p_size").alias("both"))


@query("batch_map", "SELECT doc_id, text, CAST(length(text) AS VARCHAR) || ' characters' AS response FROM documents")
def batch_map(spark, root):
    # A stand-in for a model: the step takes any function from prompts to answers.
    def answer(prompts: list[str]) -> list[str]:
        return [f"{len(p)} characters" for p in prompts]
    return g.batch_generate(table(spark, root, "documents").select("doc_id", "text"), answer, "text", "response", batch=64)
