"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import selectors as s
from ..functions.temporal import decade
from ..operators import aggregates as agg
from ..operators.joins import with_group_statistics, with_statistics
from ..session import table
from .registry import query


@query("group_by_agg", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty,
  max(l_extendedprice) AS max_price
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def group_by_agg(spark, root):
    price = F.col("l_extendedprice")
    return (table(spark, root, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
            .groupBy("l_returnflag", "l_linestatus").agg(
                F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
                F.round(F.sum(price), 2).alias("sum_price"),
                F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
                F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.max(price).alias("max_price")))


@query("group_by_len", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def group_by_len(spark, root):
    return table(spark, root, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("group_by_expression_key", """
SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) AS decade, count(*) AS n, max(o_totalprice) AS max_price FROM orders GROUP BY 1""")
def group_by_expression_key(spark, root):
    return table(spark, root, "orders").groupBy(decade(F.col("o_orderdate")).alias("decade")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("max_price"))


@query("group_by_maintain_order", """
SELECT o_orderpriority, min(o_orderkey) AS first_row, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2""")
def group_by_maintain_order(spark, root):
    return agg.first_seen(table(spark, root, "orders"), ["o_orderpriority"], "o_orderkey", n=F.count(F.lit(1))).orderBy("first_row")




@query("agg_collect_list", """
SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS prices FROM orders GROUP BY 1""")
def agg_collect_list(spark, root):
    return agg.collect_lists(table(spark, root, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", name="prices")


@query("agg_list_positions", """
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_totalprice AS price FROM orders""")
def agg_list_positions(spark, root):
    t = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return agg.list_positions(t, ["o_custkey"], "o_orderkey").select("o_custkey", "position", F.col("o_totalprice").alias("price"))


@query("agg_first_last", """
SELECT c_nationkey, min_by(c_name, c_acctbal * 1000000 + c_custkey) AS poorest, max_by(c_name, c_acctbal * 1000000 + c_custkey) AS richest
FROM customer GROUP BY 1""")
def agg_first_last(spark, root):
    order = F.struct("c_acctbal", "c_custkey")
    return table(spark, root, "customer").groupBy("c_nationkey").agg(
        F.min_by("c_name", order).alias("poorest"), F.max_by("c_name", order).alias("richest"))


@query("agg_sorted_first", "SELECT c_nationkey, min(c_name) AS first_name FROM customer GROUP BY 1")
def agg_sorted_first(spark, root):
    return table(spark, root, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("first_name"))


@query("agg_sort_by_first", """
SELECT c_nationkey, arg_min(c_mktsegment, c_name) AS segment_of_first FROM customer GROUP BY 1""")
def agg_sort_by_first(spark, root):
    return table(spark, root, "customer").groupBy("c_nationkey").agg(
        F.min_by("c_mktsegment", F.struct("c_name", "c_custkey")).alias("segment_of_first"))


@query("agg_conditional_sum", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, count(*) FILTER (WHERE o_orderstatus = 'O') AS open
FROM orders GROUP BY 1 ORDER BY closed DESC, 1 LIMIT 5""")
def agg_conditional_sum(spark, root):
    status = F.col("o_orderstatus")
    return table(spark, root, "orders").groupBy("o_orderpriority").agg(
        F.count_if(status == "F").alias("closed"), F.count_if(status == "O").alias("open")
    ).orderBy(F.col("closed").desc_nulls_last(), "o_orderpriority").limit(5)


@query("agg_filter", """
SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_discount > 0.05), 6) AS avg_high, round(avg(l_quantity) FILTER (WHERE l_discount <= 0.05), 6) AS avg_low
FROM lineitem GROUP BY 1""")
def agg_filter(spark, root):
    high = F.col("l_discount") > 0.05
    return table(spark, root, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg(F.when(high, F.col("l_quantity"))), 6).alias("avg_high"),
        F.round(F.avg(F.when(~high, F.col("l_quantity"))), 6).alias("avg_low"))


@query("agg_nested_keys", """
SELECT o_custkey, o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2 HAVING count(*) > 4""")
def agg_nested_keys(spark, root):
    return table(spark, root, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")).where("n > 4")


@query("count_non_null", """
SELECT event_type, count(CASE WHEN event_id % 7 <> 0 THEN value END) AS known, count(*) AS n FROM events GROUP BY 1""")
def count_non_null(spark, root):
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(spark, root, "events").groupBy("event_type").agg(F.count(value).alias("known"), F.count(F.lit(1)).alias("n"))


@query("n_unique", """
SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END) + 1 AS suppliers FROM lineitem""")
def n_unique(spark, root):
    some = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey"))
    return table(spark, root, "lineitem").agg(agg.n_unique(F.col("l_partkey")).alias("parts"), agg.n_unique(some).alias("suppliers"))


@query("approx_n_unique", """
SELECT n AS parts, abs(d - n) <= 0.15 * n AS close FROM (SELECT count(DISTINCT l_partkey) AS d FROM lineitem), (SELECT count(*) AS n FROM part)""")
def approx_n_unique(spark, root):
    # Only the sketch reads the large table; it is held against the row count of the small one.
    parts = table(spark, root, "part").agg(F.count(F.lit(1)).alias("parts"))
    found = table(spark, root, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.05).alias("sketch"))
    return parts.crossJoin(F.broadcast(found)).select("parts", (F.abs(F.col("sketch") - F.col("parts")) <= 0.15 * F.col("parts")).alias("close"))


@query("value_counts", "SELECT struct_pack(p_brand := p_brand, count := count(*)) AS brand FROM part GROUP BY p_brand")
def value_counts(spark, root):
    counted = agg.value_counts(table(spark, root, "part"), "p_brand")
    return counted.orderBy(F.col("count").desc(), "p_brand").select(F.struct("p_brand", "count").alias("brand"))


@query("value_counts_unnest", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
def value_counts_unnest(spark, root):
    return agg.value_counts(table(spark, root, "part"), "p_brand")


@query("unique_stable", "SELECT p_type FROM part GROUP BY 1 ORDER BY min(p_partkey)")
def unique_stable(spark, root):
    return agg.first_seen(table(spark, root, "part"), ["p_type"], "p_partkey").orderBy("first_row").select("p_type")


@query("unique_counts", "SELECT p_type, min(p_partkey) AS first_row, count(*) AS n FROM part GROUP BY 1")
def unique_counts(spark, root):
    return agg.first_seen(table(spark, root, "part"), ["p_type"], "p_partkey", n=F.count(F.lit(1))).orderBy("first_row")


@query("mean_std_all", """
SELECT round(avg(l_quantity), 7) AS l_quantity_mean, round(avg(l_extendedprice), 4) AS l_extendedprice_mean,
  round(avg(l_discount), 7) AS l_discount_mean, round(avg(l_tax), 7) AS l_tax_mean,
  round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std,
  round(stddev_samp(l_discount), 6) AS l_discount_std, round(stddev_samp(l_tax), 6) AS l_tax_std,
  round(sum(l_quantity), 2) AS l_quantity_sum, round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
  round(sum(l_discount), 2) AS l_discount_sum, round(sum(l_tax), 2) AS l_tax_sum FROM lineitem""")
def mean_std_all(spark, root):
    t = table(spark, root, "lineitem")
    digits = lambda c: 4 if c == "l_extendedprice" else 6
    names = s.floating().names(t)
    # Seven digits: with 60,000 rows the mean of two-decimal values is never halfway there.
    return t.agg(*[F.round(F.avg(c), 4 if c == "l_extendedprice" else 7).alias(f"{c}_mean") for c in names],
                 *[F.round(F.stddev_samp(c), digits(c)).alias(f"{c}_std") for c in names],
                 *[F.round(agg.sum_or_zero(F.col(c)), 2).alias(f"{c}_sum") for c in names])


@query("describe", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def describe(spark, root):
    return agg.describe(table(spark, root, "lineitem")).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("null_count", """
SELECT count(*) - count(event_id) AS event_id, count(*) - count(CASE WHEN event_id % 7 <> 0 THEN value END) AS value,
  count(*) - count(CASE WHEN event_id % 11 <> 0 THEN event_type END) AS event_type FROM events""")
def null_count(spark, root):
    e = F.col("event_id")
    return agg.null_counts(table(spark, root, "events").select(
        "event_id", F.when(e % 7 != 0, F.col("value")).alias("value"), F.when(e % 11 != 0, F.col("event_type")).alias("event_type")))


@query("agg_prefix_mean", """
SELECT l_returnflag, round(avg(l_quantity), 3) AS l_quantity, round(avg(l_extendedprice), 3) AS l_extendedprice,
  round(avg(l_discount), 3) AS l_discount, round(avg(l_tax), 3) AS l_tax FROM lineitem GROUP BY 1""")
def agg_prefix_mean(spark, root):
    t = table(spark, root, "lineitem")
    return t.groupBy("l_returnflag").agg(*(s.starts_with("l_") & s.floating()).apply(t, lambda c: F.round(F.avg(c), 3)))


@query("row_is_max_flag", """
SELECT p_partkey, p_retailprice, p_size, p_retailprice = (SELECT max(p_retailprice) FROM part) AS top_price,
  p_size = (SELECT max(p_size) FROM part) AS top_size FROM part""")
def row_is_max_flag(spark, root):
    p = table(spark, root, "part").select("p_partkey", "p_retailprice", "p_size")
    return with_statistics(p, a=F.max("p_retailprice"), b=F.max("p_size")).select(
        "p_partkey", "p_retailprice", "p_size", (F.col("p_retailprice") == F.col("a")).alias("top_price"),
        (F.col("p_size") == F.col("b")).alias("top_size"))


@query("sum_over_key_const", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(l_quantity) OVER (PARTITION BY l_suppkey) AS DOUBLE) AS total FROM lineitem""")
def sum_over_key_const(spark, root):
    t = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return with_group_statistics(t, ["l_suppkey"], total=F.sum("l_quantity")).drop("l_quantity")


@query("complex_chain", """
SELECT a.decade, b.names, a.avg_size, a.avg_price FROM (
  SELECT p_size // 10 * 10 AS decade, round(avg(p_size), 2) AS avg_size, round(avg(p_retailprice), 2) AS avg_price FROM part GROUP BY 1) a
JOIN (SELECT p_size // 10 * 10 AS decade, list(split_part(p_name, ' ', 1) ORDER BY p_partkey) AS names FROM part GROUP BY 1) b ON a.decade = b.decade""")
def complex_chain(spark, root):
    made = table(spark, root, "part").withColumns({
        "decade": (F.floor(F.col("p_size") / 10) * 10).cast("int"), "name": F.element_at(F.split("p_name", " "), 1)})
    chosen = made.select(*(s.all_columns() - s.by_name("p_name", "p_type")).columns(made))
    means = chosen.groupBy("decade").agg(
        F.round(F.avg("p_size"), 2).alias("avg_size"), F.round(F.avg("p_retailprice"), 2).alias("avg_price"))
    lists = agg.collect_lists(chosen, ["decade"], "name", "p_partkey", name="names")
    return lists.join(means, "decade")
