"""Text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..session import table
from .registry import query


@query("str_len", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, CAST(length(text) AS INTEGER) AS chars FROM documents")
def str_len(spark, root):
    return table(spark, root, "documents", "doc_id").select("doc_id", F.octet_length("text").alias("bytes"), F.char_length("text").alias("chars"))


@query("str_contains", """
SELECT p_partkey, regexp_matches(p_name, 'ring|bolt') AS part_of, starts_with(p_name, 'red') AS starts, suffix(p_name, 'bolt') AS ends FROM part""")
def str_contains(spark, root):
    c = F.col("p_name")
    return table(spark, root, "part").select(
        "p_partkey", c.rlike("ring|bolt").alias("part_of"), c.startswith("red").alias("starts"), c.endswith("bolt").alias("ends"))


@query("str_extract", """
SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=([0-9]+)') THEN regexp_extract(url, '[?&]page=([0-9]+)', 1) END AS page FROM pages""")
def str_extract(spark, root):
    return table(spark, root, "pages").select("page_id", x.extract(F.col("url"), r"[?&]page=([0-9]+)", 1).alias("page"))


@query("str_extract_all", "SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS numbers FROM documents")
def str_extract_all(spark, root):
    return table(spark, root, "documents", "doc_id").select("doc_id", x.extract_all(F.col("text"), "[0-9]+").alias("numbers"))


@query("str_replace_first", "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '-') AS once FROM customer")
def str_replace_first(spark, root):
    return table(spark, root, "customer").select("c_custkey", x.replace_first(F.col("c_name"), "[0-9]", "-").alias("once"))


@query("str_replace_all", "SELECT c_custkey, regexp_replace(c_name, '0', '-', 'g') AS every FROM customer")
def str_replace_all(spark, root):
    return table(spark, root, "customer").select("c_custkey", F.regexp_replace("c_name", "0", "-").alias("every"))


@query("str_case", """
SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS high,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part""")
def str_case(spark, root):
    return table(spark, root, "part").select(
        "p_partkey", F.lower("p_type").alias("low"), F.upper("p_name").alias("high"), x.title_case(F.col("p_name")).alias("title"))


@query("str_strip", """
SELECT c_custkey, trim(c_name, 'C0123456789') AS both, ltrim(c_name, 'Cus') AS left_only, rtrim(c_name, '0123456789') AS right_only,
  CASE WHEN starts_with(c_name, 'Customer#') THEN substring(c_name, 10) ELSE c_name END AS no_prefix,
  CASE WHEN suffix(c_name, '7') THEN left(c_name, length(c_name) - 1) ELSE c_name END AS no_suffix FROM customer""")
def str_strip(spark, root):
    c = F.col("c_name")
    return table(spark, root, "customer").select(
        "c_custkey", F.btrim(c, F.lit("C0123456789")).alias("both"), F.ltrim(c, F.lit("Cus")).alias("left_only"),
        F.rtrim(c, F.lit("0123456789")).alias("right_only"), x.strip_prefix(c, "Customer#").alias("no_prefix"),
        x.strip_suffix(c, "7").alias("no_suffix"))


@query("str_slice", """
SELECT p_partkey, substring(p_name, 3, 3) AS middle,
  CASE WHEN p_size % 2 = 0 THEN left(p_name, p_size % 7) ELSE left(p_name, greatest(length(p_name) - p_size % 7, 0)) END AS head,
  CASE WHEN p_size % 2 = 0 THEN right(p_name, p_size % 7) ELSE right(p_name, greatest(length(p_name) - p_size % 7, 0)) END AS tail FROM part""")
def str_slice(spark, root):
    c, size = F.col("p_name"), F.col("p_size")
    k = F.when(size % 2 == 0, size % 7).otherwise(-(size % 7))
    # An odd size with remainder 0 keeps all: leave out the last 0 characters.
    head = F.when((size % 2 == 1) & (size % 7 == 0), c).otherwise(x.head(c, k))
    tail = F.when((size % 2 == 1) & (size % 7 == 0), c).otherwise(x.tail(c, k))
    return table(spark, root, "part").select(
        "p_partkey", x.slice_text(c, F.lit(2), F.lit(3)).alias("middle"), head.alias("head"), tail.alias("tail"))


@query("str_split", "SELECT p_partkey, string_split(p_name, ' ') AS words, split_part(p_name, ' ', 1) AS first FROM part")
def str_split(spark, root):
    w = x.words(F.col("p_name"))
    return table(spark, root, "part").select("p_partkey", w.alias("words"), F.element_at(w, 1).alias("first"))


@query("str_upper_filter", "SELECT upper(c_name) AS c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def str_upper_filter(spark, root):
    return table(spark, root, "customer").withColumn("c_name", F.upper("c_name")).where("c_acctbal > 0").select("c_name", "c_acctbal")


@query("slugify", r"""
SELECT c_custkey, regexp_replace(regexp_replace(lower('AllBuyers' || c_name), '^allbuyers', 'all_buyers_'), '[^a-z0-9_]+', '_', 'g') AS slug FROM customer""")
def slugify(spark, root):
    return table(spark, root, "customer").select("c_custkey", x.slug(F.concat(F.lit("AllBuyers"), "c_name")).alias("slug"))


@query("slug_label", """
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Root' ELSE
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS label FROM part""")
def slug_label(spark, root):
    made = F.when(F.col("p_partkey") % 10 == 0, F.lit("-_")).otherwise(F.translate("p_name", " ", "_"))
    return table(spark, root, "part").select("p_partkey", x.slug_label(made).alias("label"))


@query("file_key_sanitize", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS key FROM pages")
def file_key_sanitize(spark, root):
    return table(spark, root, "pages").select("page_id", x.safe_key(F.col("url")).alias("key"))


@query("strip_code_fence", r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN text ELSE regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') END AS code FROM documents
WHERE doc_id % 4 <> 3 UNION ALL
SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') FROM documents WHERE doc_id % 4 = 3""")
def strip_code_fence(spark, root):
    d = table(spark, root, "documents", "doc_id")
    kind, body = F.col("doc_id") % 4, F.col("text")
    wrapped = (F.when(kind == 0, F.concat(F.lit("```python\n"), body, F.lit("\n```")))
               .when(kind == 1, F.concat(F.lit(" ```\n"), body, F.lit("\n``` \n")))
               .when(kind == 2, F.concat(F.lit("```"), F.lit("\n"), body)).otherwise(body))
    return d.select("doc_id", x.strip_code_fence(wrapped).alias("code"))
