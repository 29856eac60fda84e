"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..session import table
from .registry import query


@query("join_inner", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return o.join(c, "o_custkey", "inner")


@query("join_key_expression", """
SELECT c_custkey, c_tag, s_suppkey, s_name FROM (SELECT c_custkey, lower(c_name) AS c_tag FROM customer)
JOIN supplier ON replace(c_tag, 'customer', 'supplier') = lower(s_name)""")
def join_key_expression(spark, root):
    c = table(spark, root, "customer").select("c_custkey", F.lower("c_name").alias("c_tag"))
    c = c.withColumn("_k", F.replace("c_tag", F.lit("customer"), F.lit("supplier")))
    s = table(spark, root, "supplier").select("s_suppkey", "s_name", F.lower("s_name").alias("_k"))
    return c.join(s, "_k", "inner").drop("_k")


@query("join_left", """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def join_left(spark, root):
    c = table(spark, root, "customer").select("c_custkey", "c_name")
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.outer_join(c, o, "c_custkey", "left")


@query("join_right", """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM orders RIGHT JOIN customer ON c_custkey = o_custkey""")
def join_right(spark, root):
    c = table(spark, root, "customer").select("c_custkey", "c_name")
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.outer_join(o, c, "c_custkey", "right").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("join_full", """
SELECT c_custkey, c_name, s_suppkey, s_name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 10""")
def join_full(spark, root):
    c = table(spark, root, "customer").select("c_custkey", "c_name")
    s = table(spark, root, "supplier").select((F.col("s_suppkey") + 10).alias("k"), "s_name")
    return joins.full_join(c, s, "c_custkey", "k").withColumn("s_suppkey", F.col("k") - 10).drop("k")


@query("join_full_coalesce", """
SELECT coalesce(c_custkey, s_suppkey + 100000) AS c_custkey, c_name, s_name
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 100000""")
def join_full_coalesce(spark, root):
    c = table(spark, root, "customer").select("c_custkey", "c_name")
    s = table(spark, root, "supplier").select((F.col("s_suppkey") + 100000).alias("k"), "s_name")
    return joins.full_join(c, s, "c_custkey", "k", coalesce=True)


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(spark, root):
    o = table(spark, root, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("join_anti", """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def join_anti(spark, root):
    o = table(spark, root, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("join_non_equi", """
SELECT c_custkey, p_partkey, c_acctbal, p_retailprice FROM customer JOIN part
ON c_acctbal > p_retailprice AND c_acctbal <= p_retailprice + 1.0""")
def join_non_equi(spark, root):
    c = table(spark, root, "customer").select("c_custkey", "c_acctbal")
    p = table(spark, root, "part").select("p_partkey", "p_retailprice", (F.col("p_retailprice") + 1.0).alias("_high"))
    return joins.range_join(c, p, "c_acctbal", "p_retailprice", "_high", width=1.0).drop("_high")


PURCHASES = "SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'"
VIEWS = "SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL"


def _purchases_and_views(spark, root):
    e = table(spark, root, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return left, right


@query("join_asof_backward", f"""
SELECT a.event_id, a.user_id, a.ts, a.value, b.view_id, b.ts AS view_ts
FROM ({PURCHASES}) a ASOF LEFT JOIN ({VIEWS}) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_asof_backward(spark, root):
    left, right = _purchases_and_views(spark, root)
    return joins.as_of(left, right, "ts", ["view_id"], ["user_id"], tie="view_id", matched_on="view_ts")


@query("join_asof_tolerance", f"""
SELECT a.event_id, a.user_id, a.ts, a.value, CASE WHEN a.ts - b.ts <= INTERVAL 6 HOURS THEN b.view_id END AS view_id
FROM ({PURCHASES}) a ASOF LEFT JOIN ({VIEWS}) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_asof_tolerance(spark, root):
    left, right = _purchases_and_views(spark, root)
    return joins.as_of(left, right, "ts", ["view_id"], ["user_id"], tie="view_id", within=6 * 3_600_000_000)


@query("join_cross", "SELECT s_suppkey, s_name, r_regionkey, r_name FROM supplier CROSS JOIN region")
def join_cross(spark, root):
    return joins.cross(table(spark, root, "supplier").select("s_suppkey", "s_name"), table(spark, root, "region"))


@query("sql_join_multi", """
SELECT o_orderkey, c_custkey, c_name, n_nationkey, n_name FROM (SELECT o_orderkey, o_custkey AS c_custkey FROM orders)
LEFT JOIN (SELECT c_custkey, c_name, c_nationkey AS n_nationkey FROM customer) USING (c_custkey)
LEFT JOIN nation USING (n_nationkey)""")
def sql_join_multi(spark, root):
    table(spark, root, "orders").selectExpr("o_orderkey", "o_custkey AS c_custkey").createOrReplaceTempView("order_keys")
    table(spark, root, "customer").selectExpr("c_custkey", "c_name", "c_nationkey AS n_nationkey").createOrReplaceTempView("buyers")
    table(spark, root, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT o_orderkey, c_custkey, c_name, n_nationkey, n_name FROM order_keys "
                     "LEFT JOIN buyers USING (c_custkey) LEFT JOIN nation USING (n_nationkey)")


@query("sql_join_on", """
SELECT supplier.*, nation.n_name FROM supplier LEFT JOIN nation ON supplier.s_nationkey = nation.n_nationkey""")
def sql_join_on(spark, root):
    for name in ("supplier", "nation"):
        table(spark, root, name).createOrReplaceTempView(name)
    return spark.sql("SELECT supplier.*, nation.n_name FROM supplier LEFT JOIN nation ON supplier.s_nationkey = nation.n_nationkey")
