"""Window functions, in forms that spread a hot key over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import ordering as o
from ..operators.joins import with_group_statistics, with_statistics
from ..operators.reshape import explode_lists
from ..session import table
from .registry import query


@query("rank_dense", """
SELECT p_partkey, p_brand, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST) AS size_rank FROM part""")
def rank_dense(spark, root):
    p = table(spark, root, "part").select("p_partkey", "p_brand", "p_size")
    return o.rank_values(p, "size_rank", ["p_brand"], ["p_size"], descending=True)


@query("rank_agg_explode", """
SELECT o_custkey, o_orderkey, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS price_rank FROM orders""")
def rank_agg_explode(spark, root):
    t = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    ranked = o.rank_values(t, "price_rank", ["o_custkey"], ["o_totalprice"], method="min")
    packed = ranked.withColumn("row", F.struct("o_orderkey", "o_totalprice", "price_rank"))
    lists = agg.collect_lists(packed, ["o_custkey"], "row", "o_orderkey", name="rows").withColumns({
        n: F.col(f"rows.{n}") for n in ("o_orderkey", "o_totalprice", "price_rank")})
    return explode_lists(lists.drop("rows"), "o_orderkey", "o_totalprice", "price_rank")


@query("struct_rank", """
SELECT l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_discount DESC) AS pair_rank FROM lineitem""")
def struct_rank(spark, root):
    t = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_discount")
    ranked = o.rank_values(t, "pair_rank", ["l_returnflag"], ["l_quantity", "l_discount"], descending=True)
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", "pair_rank")


EXACT = "CAST(sum(CAST(p_retailprice AS DECIMAL(18, 2))) OVER ({0}) AS DOUBLE) / count(*) OVER ({0})"


@query("window_mean", f"""
SELECT p_partkey, {EXACT.format('PARTITION BY p_brand')} AS brand_mean, {EXACT.format('PARTITION BY p_brand, p_type')} AS type_mean,
  {EXACT.format('')} AS mean FROM part""")
def window_mean(spark, root):
    p = table(spark, root, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    # Prices have two decimals: a decimal sum is exact in any order of rows.
    price = F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double") / F.count("p_retailprice")
    p = with_group_statistics(p, ["p_brand"], brand_mean=price)
    p = with_group_statistics(p, ["p_brand", "p_type"], type_mean=price)
    return with_statistics(p, mean=price).select("p_partkey", "brand_mean", "type_mean", "mean")


@query("window_group_to_rows", """
SELECT a.s_suppkey, a.s_nationkey, b.s_name AS placed FROM
  (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) b
ON a.s_nationkey = b.s_nationkey AND a.n = b.n""")
def window_group_to_rows(spark, root):
    t = table(spark, root, "supplier")
    slots = o.number_rows(t.select("s_suppkey", "s_nationkey"), "n", "s_suppkey", None, ["s_nationkey"])
    values = o.number_rows(t, "n", "s_acctbal", "s_suppkey", ["s_nationkey"], descending=True).select(
        "s_nationkey", "n", F.col("s_name").alias("placed"))
    return o.join_back(slots, values, ["s_nationkey", "n"]).drop("n")


@query("window_explode", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def window_explode(spark, root):
    return table(spark, root, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy(
        F.col("s_nationkey").asc_nulls_last(), F.col("s_acctbal").desc_nulls_last(), "s_suppkey")


@query("window_join", """
SELECT o_orderkey, o_custkey, totals FROM orders JOIN (
  SELECT o_custkey, list(o_totalprice ORDER BY o_totalprice, o_orderkey) AS totals FROM orders GROUP BY 1) USING (o_custkey)""")
def window_join(spark, root):
    t = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return agg.lists_on_rows(t, ["o_custkey"], "o_totalprice", "o_totalprice", "o_orderkey", name="totals").drop("o_totalprice")


@query("top_n_per_group", """
SELECT p_brand, p_partkey, p_retailprice FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) <= 3""")
def top_n_per_group(spark, root):
    p = table(spark, root, "part").select("p_brand", "p_partkey", "p_retailprice")
    return agg.first_rows_of_key(p, ["p_brand"], 3, F.col("p_retailprice").desc_nulls_last(), F.col("p_partkey").asc())


@query("is_duplicated", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey, l_suppkey) > 1""")
def is_duplicated(spark, root):
    t = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return agg.duplicated_rows(t, ["l_partkey", "l_suppkey"])


GAPS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS gappy FROM events"


def _gaps(spark, root):
    return table(spark, root, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("gappy"))


@query("fill_forward_backward", f"""
SELECT event_id, user_id, gappy,
  last_value(gappy IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS forward,
  first_value(gappy IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward,
  last_value(gappy IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS forward_all FROM ({GAPS})""")
def fill_forward_backward(spark, root):
    t = o.with_order_bucket(_gaps(spark, root), "ts", "event_id")
    t = o.fill(t, {"forward": "gappy"}, "ts", "event_id", ["user_id"], backward={"backward": "gappy"}, bucketed=True)
    t = o.fill(t, {"forward_all": "gappy"}, "ts", "event_id", bucketed=True)
    return t.drop("ts", o.BUCKET)


@query("interpolate_linear", f"""
WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM ({GAPS})),
k AS (SELECT *,
  last_value(CASE WHEN gappy IS NOT NULL THEN pos END IGNORE NULLS) OVER w1 AS p0, last_value(gappy IGNORE NULLS) OVER w1 AS v0,
  first_value(CASE WHEN gappy IS NOT NULL THEN pos END IGNORE NULLS) OVER w2 AS p1, first_value(gappy IGNORE NULLS) OVER w2 AS v1
FROM g WINDOW w1 AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
  w2 AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, user_id, CASE WHEN gappy IS NOT NULL THEN gappy ELSE v0 + (v1 - v0) * ((pos - p0)::DOUBLE / (p1 - p0)::DOUBLE) END AS smooth FROM k""")
def interpolate_linear(spark, root):
    made = o.interpolate(_gaps(spark, root), "smooth", "gappy", "ts", "event_id", ["user_id"])
    return made.select("event_id", "user_id", "smooth")


@query("cum_count_reverse", """
SELECT month, CAST(n AS BIGINT) AS n, CASE WHEN n >= 3 THEN [n, n - 1, n - 2] WHEN n = 2 THEN [n, n - 1] ELSE [n] END AS last_counts FROM (
  SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders GROUP BY 1)""")
def cum_count_reverse(spark, root):
    counted = table(spark, root, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    return counted.withColumn("last_counts", F.sequence(F.col("n"), F.greatest(F.col("n") - 2, F.lit(1)), F.lit(-1)))
