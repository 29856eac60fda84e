"""Projection, column selection and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import selectors as s
from ..functions.numeric import all_across, fold
from ..operators.joins import with_statistics
from ..operators.ordering import number_rows
from ..session import table
from .registry import query


@query("select_exprs", """
SELECT p_partkey, round(p_retailprice / (p_size * p_size), 6) AS ratio,
  round((SELECT avg(p_retailprice) FROM part), 4) AS mean_price FROM part""")
def select_exprs(spark, root):
    p = table(spark, root, "part")
    return with_statistics(p, mean=F.avg("p_retailprice")).select(
        "p_partkey", F.round(F.col("p_retailprice") / (F.col("p_size") * F.col("p_size")), 6).alias("ratio"),
        F.round("mean", 4).alias("mean_price"))


@query("with_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue,
  year(l_shipdate)::INTEGER AS ship_year FROM lineitem""")
def with_columns(spark, root):
    made = table(spark, root, "lineitem").withColumns({
        "revenue": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "ship_year": F.year("l_shipdate")})
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "revenue", "ship_year")


@query("with_columns_loop", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 1.1, 6) AS l_quantity_up, round(l_extendedprice * 1.1, 6) AS l_extendedprice_up,
  round(l_quantity * 0.9, 6) AS l_quantity_down, round(l_extendedprice * 0.9, 6) AS l_extendedprice_down FROM lineitem""")
def with_columns_loop(spark, root):
    rates = {"up": 1.1, "down": 0.9}
    cols = [F.round(F.col(c) * r, 6).alias(f"{c}_{n}") for n, r in rates.items() for c in ("l_quantity", "l_extendedprice")]
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *cols)


@query("zscore_deviation", """
SELECT c_custkey, round((c_acctbal - m) / d, 6) AS deviation
FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d FROM customer)""")
def zscore_deviation(spark, root):
    c = table(spark, root, "customer").select("c_custkey", "c_acctbal")
    wide = with_statistics(c, m=F.avg("c_acctbal"), d=F.stddev_samp("c_acctbal"))
    return wide.select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("d"), 6).alias("deviation"))


@query("select_all", "SELECT * FROM customer")
def select_all(spark, root):
    return table(spark, root, "customer").select("*")


@query("select_exclude", "SELECT s_suppkey, s_acctbal FROM supplier")
def select_exclude(spark, root):
    t = table(spark, root, "supplier")
    return t.select(*(s.all_columns() - s.by_name("s_name") - s.matches("nation")).columns(t))


@query("select_by_names_fn", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 1.09, 2) AS l_quantity, round(l_extendedprice / 1.09, 2) AS l_extendedprice,
  round(l_discount / 1.09, 2) AS l_discount, round(l_tax / 1.09, 2) AS l_tax FROM lineitem""")
def select_by_names_fn(spark, root):
    t = table(spark, root, "lineitem")
    money = s.by_name("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", *money.apply(t, lambda c: F.round(c / 1.09, 2)))


@query("select_by_regex", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def select_by_regex(spark, root):
    t = table(spark, root, "lineitem")
    return t.select(*s.matches("^.*key$").columns(t))


@query("select_by_dtype", """
SELECT round(l_quantity * 1.1, 6) AS l_quantity, round(l_extendedprice * 1.1, 6) AS l_extendedprice,
  round(l_discount * 1.1, 6) AS l_discount, round(l_tax * 1.1, 6) AS l_tax FROM lineitem""")
def select_by_dtype(spark, root):
    t = table(spark, root, "lineitem")
    return t.select(*s.floating().apply(t, lambda c: F.round(c * 1.1, 6)))


@query("selector_sets", "SELECT o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def selector_sets(spark, root):
    t = table(spark, root, "orders")
    return t.select(*((s.numeric() - s.first()) | s.temporal() | (s.string() & ~s.ends_with("status"))).columns(t))


@query("selector_complement_vs_not", """
SELECT doc_id, quality, toxic, NOT (quality = 1) AS is_good, NOT (toxic = 1) AS is_toxic FROM labels""")
def selector_complement_vs_not(spark, root):
    t = table(spark, root, "labels").withColumns({"is_good": F.col("quality") == 1, "is_toxic": F.col("toxic") == 1})
    flags = s.boolean()
    return t.select(*(~flags).columns(t), *flags.negated(t))


@query("name_prefix_suffix", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS raw_l_quantity, round(l_extendedprice / 1000, 6) AS l_extendedprice_k FROM lineitem""")
def name_prefix_suffix(spark, root):
    t = table(spark, root, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", *s.by_name("l_quantity").apply(t, lambda c: c, prefix="raw_"),
                    *s.by_name("l_extendedprice").apply(t, lambda c: F.round(c / 1000, 6), suffix="_k"))


@query("name_map", "SELECT s_suppkey AS \"S_SUPPKEY\", s_name AS \"S_NAME\", s_nationkey AS \"S_NATIONKEY\", s_acctbal AS \"S_ACCTBAL\" FROM supplier")
def name_map(spark, root):
    t = table(spark, root, "supplier")
    return t.toDF(*[c.upper() for c in t.columns])


@query("with_row_index", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders""")
def with_row_index(spark, root):
    t = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    return number_rows(t, "index", "o_orderkey").withColumn("index", F.col("index") - 1)


@query("filter_predicate", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def filter_predicate(spark, root):
    return table(spark, root, "orders").where(F.col("o_totalprice") > 250000).select("o_orderkey", "o_totalprice")


@query("filter_conjunction", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND o_totalprice > 100000""")
def filter_conjunction(spark, root):
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    return table(spark, root, "orders").where(
        F.col("o_orderdate").between(day("1996-01-01"), day("1997-12-31")) & (F.col("o_totalprice") > 100000)
    ).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("filter_all_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_orderkey > 1 AND l_partkey > 1 AND l_suppkey > 1 AND l_linenumber > 1 AND l_quantity > 1 AND l_extendedprice > 1""")
def filter_all_columns(spark, root):
    t = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return t.where(fold(F.lit(True), lambda a, b: a & b, [F.col(c) > 1 for c in t.columns]))


@query("compare_ops", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 25 AS gt, l_quantity >= 25 AS ge, l_quantity < 25 AS lt, l_quantity <= 25 AS le,
  l_quantity = 25 AS eq, l_quantity <> 25 AS ne FROM lineitem""")
def compare_ops(spark, root):
    q = F.col("l_quantity")
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (q > 25).alias("gt"), (q >= 25).alias("ge"), (q < 25).alias("lt"), (q <= 25).alias("le"),
        (q == 25).alias("eq"), (q != 25).alias("ne"))


@query("boolean_ops", """
SELECT o_orderkey, (o_orderstatus = 'F' AND o_totalprice > 100000) AS both_true, (o_orderstatus = 'F' OR o_totalprice > 100000) AS any_true,
  NOT (o_orderstatus = 'F') AS negated, o_orderpriority IS NULL AS missing FROM orders""")
def boolean_ops(spark, root):
    a, b = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    return table(spark, root, "orders").select(
        "o_orderkey", all_across([a, b]).alias("both_true"), reduce(lambda x, y: x | y, [a, b]).alias("any_true"),
        (~a).alias("negated"), F.col("o_orderpriority").isNull().alias("missing"))


@query("when_then_otherwise", """
SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 1 THEN 3 * p_size + 1 ELSE floor(p_size / 2) END AS INTEGER) AS next_size FROM part""")
def when_then_otherwise(spark, root):
    n = F.col("p_size")
    return table(spark, root, "part").select(
        "p_partkey", F.when(F.pmod(n, F.lit(2)) == 1, 3 * n + 1).otherwise(F.floor(n / 2)).cast("int").alias("next_size"))
