"""Casts, arithmetic, nulls, lists, structs and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import selectors as s
from ..functions import nested as n
from ..functions import numeric as num
from ..functions import temporal as t
from ..functions.text import words
from ..operators.aggregates import first_seen
from ..operators.ordering import join_back, number_rows
from ..session import table
from .registry import query

PRIORITY = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("cast_numeric", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS FLOAT) AS as_float, CAST(trunc(l_extendedprice) AS INTEGER) AS as_int,
  CAST(l_suppkey % 1000 AS SMALLINT) AS as_small FROM lineitem""")
def cast_numeric(spark, root):
    price = F.col("l_extendedprice")
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", price.cast("float").alias("as_float"), price.cast("int").alias("as_int"),
        (F.col("l_suppkey") % 1000).cast("smallint").alias("as_small"))


@query("cast_strict", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS as_int, CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS price FROM orders")
def cast_strict(spark, root):
    # A value that does not fit raises: casts are strict under ANSI mode.
    return table(spark, root, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("int").alias("as_int"), F.col("o_totalprice").cast("string").cast("double").alias("price"))


@query("cast_lenient", """
SELECT event_id, TRY_CAST(regexp_extract(props, ': (.*)}', 1) AS TINYINT) AS k, TRY_CAST(event_type AS BIGINT) AS none FROM events""")
def cast_lenient(spark, root):
    k = F.regexp_extract("props", ": (.*)}", 1)
    return table(spark, root, "events").select(
        "event_id", k.try_cast("tinyint").alias("k"), F.col("event_type").try_cast("bigint").alias("none"))


@query("cast_string_number", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS key_text, CAST(substring(c_name, 10) AS BIGINT) AS number FROM customer""")
def cast_string_number(spark, root):
    return table(spark, root, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("key_text"), F.substring("c_name", 10, 20).cast("bigint").alias("number"))


@query("cast_bool", "SELECT doc_id, quality <> 0 AS good, CAST(toxic <> 0 AS INTEGER) AS toxic_int, (quality - toxic) <> 0 AS differs FROM labels")
def cast_bool(spark, root):
    return table(spark, root, "labels").select(
        "doc_id", F.col("quality").cast("boolean").alias("good"), F.col("toxic").cast("boolean").cast("int").alias("toxic_int"),
        (F.col("quality") - F.col("toxic")).cast("boolean").alias("differs"))


@query("cast_temporal_int", """
SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS days, epoch_us(ts) AS micros,
  (epoch_us(ts) % 86400000000) * 1000 AS nanos_of_day FROM events""")
def cast_temporal_int(spark, root):
    ts = F.col("ts")
    return table(spark, root, "events").select(
        "event_id", F.unix_date(ts.cast("date")).alias("days"), F.unix_micros(ts.cast("timestamp")).alias("micros"),
        t.nanos_of_day(ts).alias("nanos_of_day"))


@query("cast_to_other_dtype", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS like_price FROM orders")
def cast_to_other_dtype(spark, root):
    o = table(spark, root, "orders")
    return o.select("o_orderkey", F.col("o_custkey").cast(o.schema["o_totalprice"].dataType).alias("like_price"))


@query("format_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d %b %Y') AS shown FROM orders")
def format_date(spark, root):
    d = F.col("o_orderdate")
    return table(spark, root, "orders").select("o_orderkey", t.format_time(d, "%Y-%m-%d").alias("iso"), t.format_time(d, "%d %h %Y").alias("shown"))


@query("arithmetic", """
SELECT p_partkey, p_size + 5 AS plus, p_size - 5 AS minus, p_size * 3 AS times, p_size / 4 AS over, pow(p_size, 2) AS power,
  CAST((p_size - 25) - 7 * floor((p_size - 25) / 7) AS INTEGER) AS rest FROM part""")
def arithmetic(spark, root):
    x = F.col("p_size")
    return table(spark, root, "part").select(
        "p_partkey", (x + 5).alias("plus"), (x - 5).alias("minus"), (x * 3).alias("times"), (x / 4).alias("over"),
        F.pow(x, F.lit(2)).alias("power"), num.remainder(x - 25, F.lit(7)).cast("int").alias("rest"))


@query("int_floor_div", "SELECT p_partkey, CAST(floor((p_size - 25) / 7) AS BIGINT) AS quotient FROM part")
def int_floor_div(spark, root):
    return table(spark, root, "part").select("p_partkey", num.floor_div(F.col("p_size") - 25, F.lit(7)).alias("quotient"))


@query("true_divide_special", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN l_discount / l_tax WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS ratio
FROM lineitem""")
def true_divide_special(spark, root):
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", num.true_div(F.col("l_discount"), F.col("l_tax")).alias("ratio"))


@query("bitwise", "SELECT p_partkey, p_size & 12 AS both, p_size | 12 AS either, xor(p_size, 12) AS one, ~p_size AS inverse FROM part")
def bitwise(spark, root):
    x = F.col("p_size")
    return table(spark, root, "part").select(
        "p_partkey", x.bitwiseAND(12).alias("both"), x.bitwiseOR(12).alias("either"), x.bitwiseXOR(12).alias("one"), F.bitwise_not(x).alias("inverse"))


@query("round_digits", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 2) AS two, round(l_extendedprice / 7, 0) AS none FROM lineitem")
def round_digits(spark, root):
    x = F.col("l_extendedprice") / 7
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 2).alias("two"), F.round(x, 0).alias("none"))


@query("pow_log", """
SELECT round(ln(p_partkey + 1), 9) AS p_partkey, round(ln(p_size), 9) AS p_size, round(ln(p_retailprice), 9) AS p_retailprice,
  pow(p_size, 4) AS fourth FROM part""")
def pow_log(spark, root):
    p = table(spark, root, "part").withColumn("p_partkey", F.col("p_partkey") + 1)
    return p.select(*s.numeric().apply(p, lambda c: F.round(F.ln(c), 9)), F.pow("p_size", F.lit(4)).alias("fourth"))


@query("fold_sum", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_linenumber + l_suppkey AS total FROM lineitem")
def fold_sum(spark, root):
    cols = [F.col(c) for c in ("l_quantity", "l_linenumber", "l_suppkey")]
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", num.fold(F.lit(0), lambda a, b: a + b, cols).alias("total"))


@query("fold_product", "SELECT p_partkey, p_size * (p_partkey % 10) AS product, 0 * p_size * (p_partkey % 10) AS from_zero FROM part")
def fold_product(spark, root):
    cols = [F.col("p_size"), F.col("p_partkey") % 10]
    times = lambda start: num.fold(F.lit(start), lambda a, b: a * b, cols)
    return table(spark, root, "part").select("p_partkey", times(1).alias("product"), times(0).alias("from_zero"))


@query("sum_horizontal", """
SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, 0) + user_id AS total FROM events""")
def sum_horizontal(spark, root):
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(spark, root, "events").select("event_id", num.sum_across([value, F.col("user_id")]).alias("total"))


@query("concat_str", "SELECT c_custkey, c_name || ' ' || c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR) AS line FROM customer")
def concat_str(spark, root):
    return table(spark, root, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")).alias("line"))


@query("is_null", "SELECT event_id, event_id % 7 = 0 AS missing FROM events")
def is_null(spark, root):
    return _gappy(spark, root).select("event_id", F.col("gappy").isNull().alias("missing"))


def _gappy(spark, root):
    return table(spark, root, "events").withColumn("gappy", F.when(F.col("event_id") % 7 != 0, F.col("value")))


@query("fill_null_literal", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 3.0::DOUBLE ELSE value END AS filled FROM events")
def fill_null_literal(spark, root):
    return _gappy(spark, root).select("event_id", F.coalesce("gappy", F.lit(3.0)).alias("filled"))


@query("fill_null_expr", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 2.0 * user_id::DOUBLE ELSE value END AS filled FROM events")
def fill_null_expr(spark, root):
    return _gappy(spark, root).select("event_id", F.coalesce("gappy", 2.0 * F.col("user_id")).alias("filled"))


@query("fill_nan", """
SELECT event_type, CAST(sum(CAST(CASE WHEN event_id % 7 <> 0 THEN value END AS DECIMAL(18, 2))) AS DOUBLE) / count(CASE WHEN event_id % 7 <> 0 THEN value END) AS clean_mean,
  'nan'::DOUBLE AS raw_mean FROM events GROUP BY 1""")
def fill_nan(spark, root):
    e = table(spark, root, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(F.lit(float("nan"))))
    clean = num.nan_to_null(F.col("v"))
    return e.groupBy("event_type").agg(
        (F.sum(clean.cast("decimal(18,2)")).cast("double") / F.count(clean)).alias("clean_mean"), F.avg("v").alias("raw_mean"))


WORDS = "string_split(p_name, ' ')"


@query("list_head_tail_slice", f"""
SELECT p_partkey, {WORDS}[1:1] AS head, {WORDS}[-1:] AS tail, CASE WHEN len({WORDS}) >= 3 THEN {WORDS}[-3:-2] ELSE {WORDS}[1:len({WORDS}) - 1] END AS slice FROM part""")
def list_head_tail_slice(spark, root):
    w = words(F.col("p_name"))
    # Offset -3, two items: on a shorter list the part before its start is lost.
    return table(spark, root, "part").select(
        "p_partkey", n.list_head(w, 1).alias("head"), n.list_tail(w, 1).alias("tail"), n.list_slice(w, -3, 2).alias("slice"))


@query("list_eval_cast_errors", """
SELECT doc_id, CAST(len(string_split(text, ' ')) - (SELECT count(*) FROM unnest(string_split(text, ' ')) u(w) WHERE regexp_full_match(w, '\\s*[+-]?[0-9]{1,18}\\s*')) AS BIGINT) AS errors
FROM documents""")
def list_eval_cast_errors(spark, root):
    return table(spark, root, "documents", "doc_id").select(
        "doc_id", n.count_items(words(F.col("text")), n.not_whole_number).alias("errors"))


@query("list_eval_regex", """
SELECT doc_id, CAST((SELECT count(*) FROM unnest(string_split(text, ' ')) u(w) WHERE NOT regexp_full_match(w, '[0-9]+')) AS BIGINT) AS errors FROM documents""")
def list_eval_regex(spark, root):
    return table(spark, root, "documents", "doc_id").select(
        "doc_id", n.count_items(words(F.col("text")), lambda w: ~w.rlike(r"^[0-9]+\z")).alias("errors"))


FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines_with_list(spark, root):
    t_ = table(spark, root, "lineitem")
    return t_.select("l_orderkey", "l_linenumber", "l_partkey", F.array(*FOUR).alias("v"))


@query("list_sort_by_field", """
SELECT l_orderkey, l_linenumber, l_partkey, list_transform(list_sort([
  {v: l_quantity, n: 'l_quantity'}, {v: l_extendedprice, n: 'l_extendedprice'}, {v: l_discount, n: 'l_discount'}, {v: l_tax, n: 'l_tax'}]),
  lambda x: x.n) AS names FROM lineitem""")
def list_sort_by_field(spark, root):
    items = F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).alias("v")) for c in FOUR])
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.transform(n.sort_by_field(items, "v", "n"), lambda x: x["n"]).alias("names"))


@query("list_agg_min_max", """
SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_extendedprice, l_discount, l_tax) AS low,
  greatest(l_quantity, l_extendedprice, l_discount, l_tax) AS high, [greatest(l_quantity, l_extendedprice, l_discount, l_tax)] AS high_list FROM lineitem""")
def list_agg_min_max(spark, root):
    return _lines_with_list(spark, root).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_min("v").alias("low"), F.array_max("v").alias("high"),
        F.array(F.array_max("v")).alias("high_list"))


@query("list_entropy", """
SELECT l_orderkey, l_linenumber, l_partkey, round(-((a / t) * ln(a / t) + (b / t) * ln(b / t)), 9) AS entropy FROM (
  SELECT *, l_quantity AS a, l_linenumber + 1 AS b, l_quantity + l_linenumber + 1 AS t FROM lineitem)""")
def list_entropy(spark, root):
    pair = F.array(F.col("l_quantity"), (F.col("l_linenumber") + 1).cast("double"))
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(n.entropy(pair), 9).alias("entropy"))


@query("concat_list", "SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity, l_extendedprice, l_discount, l_tax] AS v FROM lineitem")
def concat_list(spark, root):
    return _lines_with_list(spark, root)


def _rank_sql(c):
    above = " + ".join(f"({d} > {c})::INT" for d in FOUR)
    same = " + ".join(f"({d} = {c})::INT" for d in FOUR)
    return f"round(({above} + ({same} + 1) / 2) / 4, 2)"


@query("list_rank_pct", f"SELECT l_orderkey, l_linenumber, l_partkey, [{', '.join(_rank_sql(c) for c in FOUR)}] AS ranks FROM lineitem")
def list_rank_pct(spark, root):
    return _lines_with_list(spark, root).select("l_orderkey", "l_linenumber", "l_partkey", n.rank_share(F.col("v")).alias("ranks"))


@query("arr_join", "SELECT doc_id, array_to_string(string_split(text, ' '), '-') AS joined FROM documents")
def arr_join(spark, root):
    return table(spark, root, "documents", "doc_id").select("doc_id", F.array_join(words(F.col("text")), "-").alias("joined"))


@query("arr_sort_max_sum", """
SELECT vec_id, list_sort(embedding)[1] AS lowest, list_max(embedding) AS highest, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""")
def arr_sort_max_sum(spark, root):
    return table(spark, root, "embeddings").select(
        "vec_id", F.get(F.array_sort("embedding"), F.lit(0)).alias("lowest"), F.array_max("embedding").alias("highest"),
        F.round(n.list_sum(F.col("embedding")), 6).alias("total"))


@query("arr_contains", "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'ring') AS has_ring FROM part")
def arr_contains(spark, root):
    return table(spark, root, "part").select("p_partkey", F.array_contains(words(F.col("p_name")), "ring").alias("has_ring"))


VECTOR_SIZE = 64


@query("fixed_array_check", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first, [[embedding[1], embedding[2]], [embedding[3], embedding[4]]] AS square FROM embeddings""")
def fixed_array_check(spark, root):
    e = table(spark, root, "embeddings")
    # Any other size than the declared one is an error.
    v = n.fixed_size(F.col("embedding"), VECTOR_SIZE)
    at = lambda i: F.get(v, F.lit(i))
    square = n.fixed_size(F.array(F.array(at(0), at(1)), F.array(at(2), at(3))), 2)
    return e.select("vec_id", F.size(v).alias("n"), at(0).alias("first"), square.alias("square"))


@query("struct_build", "SELECT p_partkey, {'p_brand': p_brand, 'p_size': p_size} AS s FROM part")
def struct_build(spark, root):
    return table(spark, root, "part").select("p_partkey", F.struct("p_brand", "p_size").alias("s"))


@query("struct_field", "SELECT p_partkey, p_size AS size FROM part")
def struct_field(spark, root):
    return struct_build(spark, root).select("p_partkey", F.col("s")["p_size"].alias("size"))


@query("struct_rename_fields", "SELECT p_partkey, {'brand': p_brand, 'size': p_size} AS s FROM part")
def struct_rename_fields(spark, root):
    return struct_build(spark, root).withColumn("s", n.rename_fields(F.col("s"), ["brand", "size"], ["string", "int"]))


@query("struct_lenient", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k, NULL::VARCHAR AS missing FROM events""")
def struct_lenient(spark, root):
    # By rule some records hold a text where a number is due.
    odd = F.when(F.col("event_id") % 5 == 0, F.lit('{"k": "many", "x": 1}')).otherwise(F.col("props"))
    made = F.from_json(odd, "k bigint, missing string", {"mode": "PERMISSIVE"})
    return table(spark, root, "events").select("event_id", made.alias("s")).select("event_id", "s.*")


@query("enum_validate", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def enum_validate(spark, root):
    known = PRIORITY[2:]
    return table(spark, root, "orders").where(~n.in_domain(F.col("o_orderpriority"), known)).select("o_orderkey", "o_orderpriority")


@query("enum_order_filter", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) > 2""")
def enum_order_filter(spark, root):
    level = n.ordinal(n.checked(F.col("o_orderpriority"), PRIORITY), PRIORITY)
    return table(spark, root, "orders").where(level > PRIORITY.index("4-NOT SPECIFIED") + 1).select("o_orderkey", "o_orderpriority")


@query("categorical_compare", """
SELECT p_partkey, p_brand > 'Brand#15' AS over_15, p_brand < p_type AS before_type, p_brand = 'Brand#2' AS is_2 FROM part""")
def categorical_compare(spark, root):
    b = F.col("p_brand")
    return table(spark, root, "part").select(
        "p_partkey", (b > "Brand#15").alias("over_15"), (b < F.col("p_type")).alias("before_type"), (b == "Brand#2").alias("is_2"))


@query("categorical_codes", """
SELECT p_partkey, p_type, code FROM part JOIN (
  SELECT p_type, row_number() OVER (ORDER BY first_row) - 1 AS code FROM (SELECT p_type, min(p_partkey) AS first_row FROM part GROUP BY 1)) USING (p_type)""")
def categorical_codes(spark, root):
    p = table(spark, root, "part").select("p_partkey", "p_type")
    seen = number_rows(first_seen(p, ["p_type"], "p_partkey"), "code", "first_row")
    return join_back(p, seen.select("p_type", (F.col("code") - 1).alias("code")), ["p_type"])


@query("json_field", """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 2 AS twice FROM events""")
def json_field(spark, root):
    k = F.variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, root, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), (k * 2).alias("twice"))


@query("dt_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def dt_year(spark, root):
    return table(spark, root, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))


@query("dt_total_days", "SELECT o_custkey, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS days FROM orders GROUP BY 1")
def dt_total_days(spark, root):
    return table(spark, root, "orders").groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))


@query("age_years", "SELECT o_orderkey, CAST(2024 - year(o_orderdate) AS INTEGER) AS age FROM orders")
def age_years(spark, root):
    return table(spark, root, "orders").select("o_orderkey", (F.lit(2024) - F.year("o_orderdate")).alias("age"))


@query("parse_date", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS strict, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS lenient FROM orders""")
def parse_date(spark, root):
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    bad = F.when(F.col("o_orderkey") % 9 == 0, F.lit("not a date")).otherwise(text)
    return table(spark, root, "orders").select(
        "o_orderkey", t.parse_date(text, "%d/%m/%Y").alias("strict"), t.parse_date(bad, "%d/%m/%Y", strict=False).alias("lenient"))


@query("parse_datetime", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS at FROM events")
def parse_datetime(spark, root):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, root, "events").select("event_id", t.parse_datetime(text, "%Y-%m-%d %H:%M:%S").alias("at"))


@query("parse_offset_datetime", """
SELECT event_id, date_trunc('second', ts)::TIMESTAMP - CASE WHEN event_id % 2 = 0 THEN INTERVAL 2 HOURS ELSE INTERVAL 330 MINUTES END + INTERVAL 1 HOUR AS in_brussels FROM events""")
def parse_offset_datetime(spark, root):
    # January: Brussels is one hour ahead of UTC.
    offset = F.when(F.col("event_id") % 2 == 0, F.lit("+0200")).otherwise(F.lit("+0530"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return table(spark, root, "events").select("event_id", t.parse_offset(text, "%Y-%m-%dT%H:%M:%S%z", "Europe/Brussels").alias("in_brussels"))


@query("tz_replace", "SELECT event_id, ts AS clock, 'Europe/Brussels' AS zone, ts - INTERVAL 1 HOUR AS utc_clock FROM events")
def tz_replace(spark, root):
    zone = "Europe/Brussels"
    return table(spark, root, "events").select(
        "event_id", F.col("ts").alias("clock"), F.lit(zone).alias("zone"), t.zone_instant(F.col("ts"), zone).alias("utc_clock"))


@query("tz_convert", "SELECT event_id, ts + INTERVAL 345 MINUTES AS in_kathmandu FROM events")
def tz_convert(spark, root):
    return table(spark, root, "events").select("event_id", t.zone_convert(F.col("ts"), "UTC", "Asia/Kathmandu").alias("in_kathmandu"))


@query("negative_years", """
SELECT o_orderkey, CAST(-(year(o_orderdate) - 700) AS INTEGER) AS year FROM orders WHERE -(year(o_orderdate) - 700) < -1293""")
def negative_years(spark, root):
    # Order dates moved to the same day of a year before year 0.
    text = F.concat(F.lit("-"), F.lpad((F.year("o_orderdate") - 700).cast("string"), 4, "0"), F.date_format("o_orderdate", "-MM"), F.lit("-01"))
    made = table(spark, root, "orders").select("o_orderkey", text.cast("date").alias("day"))
    return made.where(F.year("day") < -1293).select("o_orderkey", F.year("day").alias("year"))
