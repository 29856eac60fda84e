"""Sorting, slices and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .registry import query


def _orders(spark, root):
    return table(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")


@query("sort", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey")
def sort(spark, root):
    return _orders(spark, root).orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last())


@query("sort_limit", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def sort_limit(spark, root):
    return _orders(spark, root).orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()).limit(10)


@query("head", "SELECT * FROM (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 50) WHERE o_totalprice > 100000")
def head(spark, root):
    return _orders(spark, root).orderBy("o_orderkey").limit(50).where("o_totalprice > 100000")


@query("tail", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def tail(spark, root):
    return _orders(spark, root).orderBy(F.col("o_orderkey").desc()).limit(10).orderBy("o_orderkey")


@query("slice_offset", """
SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY o_custkey LIMIT 20 OFFSET 5""")
def slice_offset(spark, root):
    counted = table(spark, root, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("o_custkey").offset(5).limit(20)


@query("sample_n", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY md5(o_orderkey || '-42'), o_orderkey LIMIT 20")
def sample_n(spark, root):
    # A fixed hash of key and seed: the same rows on every run and retry.
    return _orders(spark, root).orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("-42"))), "o_orderkey").limit(20)
