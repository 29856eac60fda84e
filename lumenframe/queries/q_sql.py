"""The SQL surface, and plans that share work or run as a stream."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..session import scratch_dir, table
from ..sources.files import scan_csv, write_csv
from ..streaming.bounded import run_once
from .registry import query


def _sql(spark, root, text, *names):
    """Run SQL in which {name} stands for a table; no view is left behind."""
    return spark.sql(text, **{name: table(spark, root, name) for name in names})


@query("sql_register", """
SELECT c_mktsegment, m.rank, count(*) AS n FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('HOUSEHOLD', 3)) m(seg, rank)
ON c_mktsegment = m.seg GROUP BY ALL""")
def sql_register(spark, root):
    ranks = spark.createDataFrame(pd.DataFrame({"seg": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "rank": [1, 2, 3]}), "seg string, rank int")
    return spark.sql("SELECT c_mktsegment, rank, count(*) AS n FROM {buyers} JOIN {ranks} ON c_mktsegment = seg GROUP BY ALL",
                     buyers=table(spark, root, "customer"), ranks=ranks)


@query("sql_select_limit", "SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def sql_select_limit(spark, root):
    return _sql(spark, root, "SELECT * FROM {part} ORDER BY p_partkey LIMIT 5", "part")


@query("sql_group_by", "SELECT c_nationkey, round(avg(c_acctbal), 4) AS avg_balance FROM customer GROUP BY c_nationkey")
def sql_group_by(spark, root):
    return _sql(spark, root, "SELECT c_nationkey, round(avg(c_acctbal), 4) AS avg_balance FROM {customer} GROUP BY c_nationkey", "customer")


@query("sql_order_by", "SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_name")
def sql_order_by(spark, root):
    return _sql(spark, root, "SELECT s_name, s_acctbal FROM {supplier} ORDER BY s_acctbal DESC NULLS LAST, s_name", "supplier")


@query("sql_function", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, 'S')")
def sql_function(spark, root):
    return _sql(spark, root, "SELECT p_partkey, p_name FROM {part} WHERE startswith(p_type, 'S')", "part")


@query("sql_table_function", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def sql_table_function(spark, root):
    folder = write_csv(table(spark, root, "customer"), scratch_dir(spark, "customer"))
    name = f"customer_csv_{uuid.uuid4().hex}"
    # The view reads CSV by the library's rules, not by those of the built-in source.
    scan_csv(spark, folder, schema="c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").createTempView(name)
    found = spark.sql(f"SELECT c_custkey, c_name, c_acctbal FROM {name} WHERE c_acctbal > 0")
    spark.catalog.dropTempView(name)
    return found


CTE = """
WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000)
SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM big GROUP BY o_custkey"""


@query("sql_cte", CTE)
def sql_cte(spark, root):
    return _sql(spark, root, CTE.replace("FROM orders", "FROM {orders}"), "orders")


@query("sql_ctas", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sql_ctas(spark, root):
    folder, name = scratch_dir(spark, "closed-orders"), f"closed_orders_{uuid.uuid4().hex}"
    _sql(spark, root, f"CREATE TABLE {name} USING parquet LOCATION '{folder}' AS SELECT o_orderkey, o_totalprice FROM {{orders}} WHERE o_orderstatus = 'F'", "orders")
    stored = spark.read.parquet(folder)
    # The files stay at the location; the name goes, so that nothing depends on earlier queries.
    spark.sql(f"DROP TABLE {name}")
    return stored


@query("lazy_filter_group", """
SELECT l_returnflag, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem WHERE l_quantity > 20 GROUP BY 1""")
def lazy_filter_group(spark, root):
    return table(spark, root, "lineitem").where("l_quantity > 20").groupBy("l_returnflag").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


@query("collect_all_shared", """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY o_custkey) AS pos FROM c)
SELECT 'first' AS half, o_custkey, n FROM r WHERE pos <= 10
UNION ALL SELECT 'second', o_custkey, n FROM r WHERE pos BETWEEN 11 AND 20
UNION ALL SELECT 'all', count(*), CAST(sum(n) AS BIGINT) FROM c""")
def collect_all_shared(spark, root):
    # One plan: the three uses of the counts share their shuffle.
    counted = table(spark, root, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.orderBy("o_custkey")
    cut = lambda frame, name: frame.select(F.lit(name).alias("half"), "o_custkey", "n")
    total = counted.agg(F.count(F.lit(1)).alias("o_custkey"), F.sum("n").alias("n"))
    return cut(ordered.limit(10), "first").union(cut(ordered.offset(10).limit(10), "second")).union(cut(total, "all"))


@query("bounded_stream", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE value > 5 GROUP BY 1""")
def bounded_stream(spark, root):
    schema = table(spark, root, "events").schema
    return run_once(spark, f"{root}/events.parquet", schema, lambda e: e.where("value > 5").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value")), ["event_type"])
