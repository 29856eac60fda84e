"""Scans and sinks: write a copy, read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.context import row_map
from ..session import scratch_dir, table
from ..sources import files, lines
from ..sources.encodings import CP1252
from .registry import query

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_DDL = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
NTZ_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _orders_by_status(spark, root):
    return files.write_parquet(table(spark, root, "orders"), scratch_dir(spark, "orders"), ["o_orderstatus"])


@query("scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem")
def scan_parquet(spark, root):
    return files.scan_parquet(spark, f"{root}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")


@query("scan_parquet_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 100")
def scan_parquet_pushdown(spark, root):
    return files.scan_parquet(spark, f"{root}/orders.parquet").where("o_orderkey < 100").select("o_orderkey", "o_totalprice")


@query("scan_parquet_glob", ORDERS)
def scan_parquet_glob(spark, root):
    return files.scan_parquet(spark, _orders_by_status(spark, root), glob="*.parquet")


@query("scan_hive_dir", ORDERS)
def scan_hive_dir(spark, root):
    return files.scan_parquet(spark, _orders_by_status(spark, root))


@query("scan_hive_mixed_guard", ORDERS)
def scan_hive_mixed_guard(spark, root):
    folder = _orders_by_status(spark, root)
    note = table(spark, root, "region").select("r_name").coalesce(1)
    note.write.mode("append").text(f"{folder}/o_orderstatus=F")
    return files.scan_parquet(spark, folder, glob="*.parquet")


@query("scan_files_no_hive", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_files_no_hive(spark, root):
    folder = _orders_by_status(spark, root)
    return files.scan_leaves(spark, [f"{folder}/o_orderstatus={s}" for s in ("F", "O", "P")])


@query("scan_files_hive", ORDERS)
def scan_files_hive(spark, root):
    folder = _orders_by_status(spark, root)
    return files.scan_parquet(spark, *[f"{folder}/o_orderstatus={s}" for s in ("F", "O", "P")], base=folder)


@query("write_parquet", "SELECT * FROM part")
def write_parquet(spark, root):
    return spark.read.parquet(files.write_parquet(table(spark, root, "part"), scratch_dir(spark, "part")))


@query("write_parquet_partitioned", "SELECT * FROM lineitem")
def write_parquet_partitioned(spark, root):
    return spark.read.parquet(files.write_parquet(
        table(spark, root, "lineitem"), scratch_dir(spark, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("scan_csv", CUSTOMER)
def scan_csv(spark, root):
    folder = files.write_csv(table(spark, root, "customer"), scratch_dir(spark, "customer"))
    return files.scan_csv(spark, folder, schema=CUSTOMER_DDL)


@query("scan_csv_overrides", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_overrides(spark, root):
    folder = files.write_csv(table(spark, root, "customer"), scratch_dir(spark, "customer"))
    return files.scan_csv(spark, folder, overrides={"c_custkey": "string"})


def _customer_in_five(spark, root):
    folder = scratch_dir(spark, "customer5")
    parted = table(spark, root, "customer").withColumn("piece", F.col("c_custkey") % 5)
    parted.write.mode("overwrite").partitionBy("piece").option("header", True).csv(folder)
    return folder


@query("scan_csv_multi", CUSTOMER)
def scan_csv_multi(spark, root):
    return files.scan_csv(spark, f"{_customer_in_five(spark, root)}/piece=*/*.csv", schema=CUSTOMER_DDL)


@query("per_file_query", """
SELECT c_custkey % 5 AS piece, c_mktsegment, count(*) AS customers, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS balance
FROM customer GROUP BY 1, 2""")
def per_file_query(spark, root):
    scan = files.scan_csv(spark, f"{_customer_in_five(spark, root)}/piece=*/*.csv", schema=CUSTOMER_DDL, file="file")
    piece = F.regexp_extract(files.plain_path(F.col("file")), r"piece=(\d+)/", 1).cast("bigint")
    return scan.groupBy(piece.alias("piece"), "c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def _quoted(text):
    """A text as other tools write it: in quotes, quotes doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _documents_as_csv(spark, root, folder, encode=None, mark=False, **more):
    """Raw CSV text of `documents` with CRLF ends, not made by a CSV writer: titles with commas, quotes and line breaks, notes that
    are null, empty or text by rule. `encode` turns a text into bytes held in a text column."""
    i = F.col("doc_id")
    title = F.concat(F.lit('No. "'), i.cast("string"), F.lit('",\r\n'), F.col("source"))
    note = F.when(i % 3 == 0, "").when(i % 3 == 1, '""').otherwise(F.lit("plain 5\" note"))
    row = F.concat_ws(",", i.cast("string"), _quoted(title), note, _quoted(F.concat(*more.get("lead", [F.lit("")]), F.col("text"))))
    rows = table(spark, root, "documents").where(more.get("only", F.lit(True))).select(F.concat(row, F.lit("\r")).alias("value"))
    # Each task writes one file, so its first row gets the header.
    header = ("\ufeff" if mark else "") + "doc_id,title,note,text\r\n"
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = rows.withColumn("value", F.when(place == 0, F.concat(F.lit(header), "value")).otherwise(F.col("value")))
    (lines.select(encode(F.col("value")).alias("value")) if encode else lines).write.text(folder)
    return folder


CSV_DDL = "doc_id bigint, title string, note string, text string"


def _csv_sql(lead="''"):
    return f"""
SELECT doc_id, 'No. "' || doc_id || '",' || chr(13) || chr(10) || source AS title,
  CASE doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'plain 5" note' END AS note, {lead} || text AS text FROM documents"""


@query("scan_csv_quoted", _csv_sql())
def scan_csv_quoted(spark, root):
    return files.scan_csv(spark, _documents_as_csv(spark, root, scratch_dir(spark, "quoted")), schema=CSV_DDL)


def _as_latin1(text):
    return F.encode(text, "ISO-8859-1").cast("string")


def _as_cp1252(text):
    return _as_latin1(F.translate(text, CP1252, "".join(map(chr, range(0x80, 0xA0)))))


# Which documents can be written in one byte a character, and which of these as which encoding.
ONE_BYTE = r"^[\x00-\x7F\u00A0-\u00FF]*\z"
ENCODINGS_LEAD = {"cp1252": "“€é” ", "latin1": "\x81é ", "utf8": "é€\x81 ", "plain": ""}


def _encoding(text, doc_id):
    fits = text.rlike(ONE_BYTE)
    return (F.when(fits & (doc_id % 4 == 0), "cp1252").when(fits & (doc_id % 4 == 1), "latin1").when(doc_id % 4 == 2, "utf8").otherwise("plain"))


ENCODINGS_SQL = r"""CASE WHEN doc_id % 4 = 0 AND regexp_full_match(text, '[\x00-\x7F\x{A0}-\x{FF}]*') THEN '“€é” '
  WHEN doc_id % 4 = 1 AND regexp_full_match(text, '[\x00-\x7F\x{A0}-\x{FF}]*') THEN chr(129) || 'é ' WHEN doc_id % 4 = 2 THEN 'é€' || chr(129) || ' ' ELSE '' END"""


@query("scan_csv_encodings", _csv_sql(ENCODINGS_SQL))
def scan_csv_encodings(spark, root):
    # One folder with files in Windows-1252, Latin-1, UTF-8 with a mark, and UTF-8.
    base = scratch_dir(spark, "encoded")
    for kind, lead in ENCODINGS_LEAD.items():
        how = {"cp1252": _as_cp1252, "latin1": _as_latin1}.get(kind)
        _documents_as_csv(spark, root, f"{base}/{kind}", how, kind == "utf8", only=_encoding(F.col("text"), F.col("doc_id")) == kind, lead=[F.lit(lead)])
    return files.scan_csv(spark, *[f"{base}/{kind}" for kind in ENCODINGS_LEAD], schema=CSV_DDL)


@query("write_csv", "SELECT * FROM supplier")
def write_csv(spark, root):
    folder = files.write_csv(table(spark, root, "supplier"), scratch_dir(spark, "supplier"), gzip=True)
    return files.scan_csv(spark, folder, schema="s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("scan_json_doc", """
SELECT doc_id, text, {'source': source, 'note': 'a } "b" ] \\'} AS inner FROM documents""")
def scan_json_doc(spark, root):
    # Documents of at most 500 rows each, one per file, with braces and quotes in texts and nested objects.
    rows = table(spark, root, "documents")
    entry = F.to_json(F.struct("doc_id", F.struct("source", F.lit('a } "b" ] \\').alias("note")).alias("inner"), "text"))
    docs = rows.groupBy(F.floor(F.col("doc_id") / 500).alias("doc")).agg(F.array_join(F.collect_list(entry), ",\n").alias("_body"))
    folder = scratch_dir(spark, "docs")
    docs.select("doc", F.concat(F.lit("["), "_body", F.lit("]")).alias("value")).write.partitionBy("doc").text(folder)
    return files.scan_json(spark, folder, "doc_id bigint, text string, inner struct<source:string,note:string>", lines=False)


@query("scan_ndjson", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def scan_ndjson(spark, root):
    text = table(spark, root, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    folder = files.write_jsonl(text, scratch_dir(spark, "events"))
    return (spark.read.schema(NTZ_EVENTS).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder))


@query("write_json", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, event_type FROM events""")
def write_json(spark, root):
    rows = table(spark, root, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "event_type")
    folder = files.write_jsonl(rows, scratch_dir(spark, "events"))
    return files.scan_json(spark, folder, "event_id bigint, value double, event_type string")


@query("scan_file_paths", "SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS folder, true AS filled FROM orders")
def scan_file_paths(spark, root):
    folder = _orders_by_status(spark, root)
    found = files.file_list(spark, folder).select(files.relative_path(spark, folder, F.col("path")).alias("path"), "length")
    return found.where(F.col("path").contains("/part-")).groupBy(F.substring_index("path", "/", 1).alias("folder")).agg((F.min("length") > 0).alias("filled"))


@query("load_dataset_any", """
SELECT 'csv' AS shape, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier
UNION ALL SELECT 'jsonl', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier
UNION ALL SELECT 'parquet', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier""")
def load_dataset_any(spark, root):
    rows = table(spark, root, "supplier")
    base = scratch_dir(spark, "any")
    files.write_csv(rows, f"{base}/a.csv")
    files.write_jsonl(rows, f"{base}/a.jsonl")
    files.write_parquet(rows, f"{base}/a.parquet")
    out = None
    for shape in ("csv", "jsonl", "parquet"):
        got = files.scan_any(spark, f"{base}/a.{shape}").agg(
            F.lit(shape).alias("shape"), F.count(F.lit(1)).alias("n"), F.sum(F.col("s_suppkey").cast("bigint")).alias("total"))
        out = got if out is None else out.unionByName(got)
    return out


@query("write_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def write_jsonl(spark, root):
    folder = files.write_jsonl(table(spark, root, "conversations"), scratch_dir(spark, "jsonl"))
    return files.scan_json(spark, folder, "conv_id bigint, turn bigint, role string, text string")


def _json_lines(spark, root):
    """One JSON line per turn in (conv_id, turn) order; by rule some lines are cut
    short, and some are followed by a blank line."""
    t = table(spark, root, "conversations")
    n = F.col("conv_id") * 31 + F.col("turn")
    body = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    text = F.when(n % 11 == 0, F.substring(body, F.lit(1), F.char_length(body) - 1)).otherwise(body)
    text = F.when(n % 13 == 0, F.concat(text, F.lit("\n"))).otherwise(text)
    folder = scratch_dir(spark, "lines")
    t.orderBy("conv_id", "turn").select(text.alias("value")).write.text(folder)
    return folder


@query("jsonl_parse_numbered", """
SELECT CASE WHEN (conv_id * 31 + turn) % 11 = 0 THEN NULL ELSE conv_id END AS conv_id,
  CASE WHEN (conv_id * 31 + turn) % 11 = 0 THEN NULL ELSE turn END AS turn,
  CASE WHEN (conv_id * 31 + turn) % 11 = 0 THEN NULL ELSE text END AS text,
  CASE WHEN (conv_id * 31 + turn) % 11 = 0 THEN 'invalid JSON' END AS error FROM conversations""")
def jsonl_parse_numbered(spark, root):
    parsed = lines.parse_lines(lines.numbered_lines(spark, _json_lines(spark, root)))
    v = F.col("json")
    return parsed.select(F.variant_get(v, "$.conv_id", "bigint").alias("conv_id"), F.variant_get(v, "$.turn", "bigint").alias("turn"),
                         F.variant_get(v, "$.text", "string").alias("text"), "error")


@query("csv_row_pick", """
SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS row_number, 'c_acctbal=' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey % 100 AS VARCHAR) END
  || ';c_custkey=' || CAST(c_custkey AS VARCHAR) || ';c_name=' || c_name AS row_text FROM customer""")
def csv_row_pick(spark, root):
    rows = table(spark, root, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 100).alias("c_acctbal"))
    # Sorted over many files; numbers go on from file to file.
    folder = files.write_csv(rows.orderBy("c_custkey"), scratch_dir(spark, "pick"))
    scan = files.scan_csv(spark, folder, schema="c_custkey bigint, c_name string, c_acctbal bigint", number="row_number", across=True)
    entries = F.array_sort(F.transform(F.map_entries("row"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return scan.select("c_custkey", "row_number", row_map(scan.drop("row_number")).alias("row")).select(
        "c_custkey", "row_number", F.array_join(entries, ";").alias("row_text"))


@query("text_encoding_fallback", f"SELECT doc_id, {ENCODINGS_SQL} || text AS text FROM documents")
def text_encoding_fallback(spark, root):
    # JSON lines in one folder: files in Windows-1252, Latin-1, UTF-8 with a mark, and UTF-8.
    base = scratch_dir(spark, "encoded")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    for kind, lead in ENCODINGS_LEAD.items():
        how = {"cp1252": _as_cp1252, "latin1": _as_latin1}.get(kind, lambda c: c)
        rows = table(spark, root, "documents").where(_encoding(F.col("text"), F.col("doc_id")) == kind)
        line = F.to_json(F.struct("doc_id", F.concat(F.lit(lead), "text").alias("text")))
        if kind == "utf8":
            line = F.when(place == 0, F.concat(F.lit("\ufeff"), line)).otherwise(line)
        rows.select(how(line).alias("value")).write.text(f"{base}/{kind}")
    return files.scan_json(spark, f"{base}/*", "doc_id bigint, text string", any_encoding=True)
