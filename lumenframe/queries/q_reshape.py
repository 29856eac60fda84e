"""Concatenation, pivots, lists and structs to rows and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as r
from ..session import table
from .registry import query


@query("concat_vertical", """
SELECT c_custkey, c_name, 'low' AS band FROM customer WHERE c_acctbal < 1000
UNION ALL SELECT c_custkey, c_name, 'high' FROM customer WHERE c_acctbal >= 1000""")
def concat_vertical(spark, root):
    c = table(spark, root, "customer")
    cut = lambda test, band: c.where(test).select("c_custkey", "c_name", F.lit(band).alias("band"))
    return r.stack_rows(cut("c_acctbal < 1000", "low"), cut("c_acctbal >= 1000", "high"))


@query("concat_diagonal", """
SELECT c_custkey, c_nationkey AS nation, NULL::BIGINT AS s_suppkey, c_acctbal AS balance FROM customer
UNION ALL SELECT NULL, s_nationkey, s_suppkey, s_acctbal FROM supplier""")
def concat_diagonal(spark, root):
    c = table(spark, root, "customer").selectExpr("c_custkey", "c_nationkey AS nation", "c_acctbal AS balance")
    s = table(spark, root, "supplier").selectExpr("s_suppkey", "s_nationkey AS nation", "s_acctbal AS balance")
    return r.stack_diagonal(c, s)


@query("concat_horizontal", """
SELECT c_custkey, c_name, s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) a
FULL JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) b ON a.n = b.n""")
def concat_horizontal(spark, root):
    return r.side_by_side(table(spark, root, "customer").select("c_custkey", "c_name"),
                          table(spark, root, "supplier").select("s_suppkey", "s_name"), "c_custkey", "s_suppkey")


PIVOT = """
SELECT o_orderpriority, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS "F",
  arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS "O",
  arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""


@query("pivot_first", PIVOT)
def pivot_first(spark, root):
    return r.pivot(table(spark, root, "orders"), ["o_orderpriority"], "o_orderstatus", F.min_by("o_totalprice", "o_orderkey"))


@query("pivot_static", PIVOT)
def pivot_static(spark, root):
    return r.pivot(table(spark, root, "orders"), ["o_orderpriority"], "o_orderstatus", F.min_by("o_totalprice", "o_orderkey"),
                   ["F", "O", "P"])


@query("pivot_then_filter", """
SELECT * FROM (SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS "F",
  CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS "O", CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS "P"
FROM orders GROUP BY 1) WHERE "F" > 3""")
def pivot_then_filter(spark, root):
    wide = r.pivot(table(spark, root, "orders"), ["o_custkey"], "o_orderstatus", F.count(F.lit(1)), ["F", "O", "P"])
    return wide.fillna(0).where(F.col("F") > 3)


@query("unpivot", """
SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem""")
def unpivot(spark, root):
    return r.unpivot(table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@query("explode", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
def explode(spark, root):
    return r.explode_lists(table(spark, root, "documents").select("doc_id", F.split("text", " ").alias("word")), "word")


@query("unnest_struct", "SELECT p_partkey, p_brand AS brand, p_size AS size FROM part")
def unnest_struct(spark, root):
    s = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return table(spark, root, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.*")
