"""Row contexts and placeholder rewriting: snippets of `documents` with one row of `customer`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import context as x
from ..session import scratch_dir, table
from ..sources.csv import pick_record, write_csv
from .registry import query

# Snippets are documents, each led by one of these; the row that fills them is picked by its number.
PICKED = 7
TEMPLATES = [
    ("t1", "df.filter(col('{metric_column}') > {value:c_acctbal})"),
    ("t2", "<dataset>.select('<entity_column>', '{id_column}') # {row}"),
    ("t3", "row = df[{value:c_custkey}]; say('{column:c_name}', '<value:c_name>')"),
    ("t4", "  {date_column} stays, dfs and rows stay, df_row stays; df row  "),
    ("t5", "{value:c_mktsegment}/{column:c_nationkey}"),
]
CUSTOMER = {"entity_column": ["nothing", "c_name"], "metric_column": ["c_acctbal"], "date_column": ["c_since"], "id_column": ["c_custkey"]}

VALUE = {"c_custkey": "CAST(c_custkey AS VARCHAR)", "c_name": "c_name", "c_nationkey": "CAST(c_nationkey AS VARCHAR)",
         "c_acctbal": "CAST(c_acctbal AS VARCHAR)", "c_mktsegment": "c_mktsegment"}


def _sql_text(t):
    return "'" + t.replace("'", "''") + "'"


DRAFTS = {
    "t1": "'best_buyers.filter(col(''c_acctbal'') > ' || CAST(c_acctbal AS VARCHAR) || ')'",
    "t2": "'best_buyers.select(''c_name'', ''c_custkey'') # best_buyers_row'",
    "t3": "'best_buyers_row = best_buyers[' || CAST(c_custkey AS VARCHAR) || ']; say(''c_name'', ''' || c_name || ''')'",
    "t4": "'{date_column} stays, dfs and rows stay, df_row stays; best_buyers best_buyers_row'",
    "t5": "c_mktsegment || '/c_nationkey'",
}


BODY = "regexp_replace(regexp_replace(body, '(^|[^\\pL\\pM\\pN_])df($|[^\\pL\\pM\\pN_])', '\\1best_buyers\\2', 'g'), '(^|[^\\pL\\pM\\pN_])row($|[^\\pL\\pM\\pN_])', '\\1best_buyers_row\\2', 'g')"


def _drafts_sql(columns):
    """Snippets of `documents` with one row of `customer`."""
    snippet = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {_sql_text(t.strip())}" for i, (_, t) in enumerate(TEMPLATES)) + " END"
    draft = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {DRAFTS[k]}" for i, (k, _) in enumerate(TEMPLATES)) + " END"
    return f"""
SELECT doc_id AS id, lang, CAST({PICKED} AS BIGINT) AS row_index, CASE WHEN doc_id % 11 = 0 THEN '' ELSE {snippet} || ' / ' || body END AS snippet,
  CASE WHEN doc_id % 11 <> 0 THEN {draft} || ' / ' || {BODY} END AS rule_based_draft, CASE WHEN doc_id % 11 = 0 THEN 'empty snippet' END AS error{columns}
FROM (SELECT doc_id, lang, regexp_replace(text, '[\\s\\pZ]+$', '') AS body FROM documents), (SELECT * FROM customer ORDER BY c_custkey LIMIT 1 OFFSET {PICKED - 1})"""


def _requests(spark, root):
    d = table(spark, root, "documents", "doc_id")
    parts = F.array(*[F.lit(t.strip()) for _, t in TEMPLATES])
    snippet = F.when(F.col("doc_id") % 11 == 0, F.lit(" \n ")).otherwise(F.concat(F.get(parts, (F.col("doc_id") % 5).cast("int")), F.lit(" / "), F.col("text")))
    folder = write_csv(table(spark, root, "customer").orderBy("c_custkey"), scratch_dir(spark, "customers"))
    row = pick_record(spark, folder, n=PICKED)
    return x.contextualize(d.select(F.col("doc_id").alias("id"), "lang", snippet.alias("snippet")), row, "BestBuyers", PICKED,
                           source="data/BestBuyers.csv", priorities=CUSTOMER)


@query("cross_contextualize", _drafts_sql(""))
def cross_contextualize(spark, root):
    return _requests(spark, root).select("id", "lang", "row_index", "snippet", "rule_based_draft", "error")


def _block_sql(pairs):
    body = " || ',' || chr(10) || ".join(f"'  \"{k}\": ' || to_json({v})" for k, v in pairs.items())
    return f"'{{' || chr(10) || {body} || chr(10) || '}}'"


# The message's fixed lines, in full.
OPENING_LINES = [
    "Contextualize the snippet with the provided CSV sample.", "", "Rules:", "- Keep the snippet language and overall intent.",
    "- Replace generic placeholders with concrete dataset values.", "- Prefer exact CSV column names when referencing fields.",
    "- Prefer the provided dataset_var_name and row_var_name for new variable names.", "- Do not add explanations before or after the snippet.", "",
]
LINES = [f"'{line}'" for line in OPENING_LINES]


@query("build_message", f"""
SELECT id, row_index, CASE WHEN error IS NULL THEN array_to_string([{', '.join(LINES)}, 'Original snippet:', snippet, '', 'Rule-based draft:', rule_based_draft, '', 'CSV row context:',
  {_block_sql(VALUE)}, '', 'Column aliases:', {_block_sql({k: f"'{k}'" for k in VALUE})}, '', 'Representative columns:',
  {_block_sql({'entity_column': "'c_name'", 'metric_column': "'c_acctbal'", 'id_column': "'c_custkey'"})}, '', 'Return only the final contextualized snippet.'], chr(10)) END AS message
FROM ({_drafts_sql(", c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment")})""")
def build_message(spark, root):
    return _requests(spark, root).select("id", "row_index", "message")


@query("placeholder_replace", """
SELECT c_custkey, replace(replace(CASE WHEN c_custkey % 3 = 0 THEN 'a {two} b' ELSE 'a {one} b' END, '{one}', CASE WHEN c_custkey % 5 = 0 THEN '{one}' ELSE '{two} ' || c_name END),
  '{two}', c_mktsegment) AS text FROM customer""")
def placeholder_replace(spark, root):
    i = F.col("c_custkey")
    text = F.when(i % 3 == 0, F.lit("a {two} b")).otherwise(F.lit("a {one} b"))
    one = F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("{two} "), "c_name"))
    return table(spark, root, "customer").select("c_custkey", x.replace_tokens(text, x.token_map([("{one}", one), ("{two}", F.col("c_mktsegment"))])).alias("text"))


@query("word_replace", r"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text || ' theé édf df the', '[\pL\pM\pN_]+|[^\pL\pM\pN_]+'),
  lambda w: CASE w WHEN 'the' THEN 'sales' WHEN 'die' THEN 'sales_row' WHEN 'df' THEN 'x' ELSE w END), '') AS text FROM documents""")
def word_replace(spark, root):
    # Words of the given texts, on all rows.
    text = F.concat("text", F.lit(" theé édf df the"))
    return table(spark, root, "documents", "doc_id").select("doc_id", x.replace_words(text, {"the": "sales", "die": "sales_row", "df": "x"}).alias("text"))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _orders_text(spark, root):
    o = table(spark, root, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "M/d/yyyy"))
    return o.withColumnsRenamed({"o_custkey": "BuyerID", "o_totalprice": "TotalPrice"})


@query("classify_column", """
SELECT o_orderkey, 'o_orderkey' AS name, 'numeric' AS kind FROM orders UNION ALL SELECT o_orderkey, 'BuyerID', 'identifier' FROM orders
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'text' FROM orders UNION ALL SELECT o_orderkey, 'TotalPrice', 'numeric' FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate', 'date' FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', 'text' FROM orders""")
def classify_column(spark, root):
    o = _orders_text(spark, root)
    cells = x.as_text(o).withColumn("key", F.col("o_orderkey").cast("bigint")).unpivot("key", o.columns, "name", "value")
    return cells.select(F.col("key").alias("o_orderkey"), "name", x.column_kind(F.col("name"), F.col("value")).alias("kind"))


@query("column_profile", """
SELECT o_orderkey, ['o_orderkey', 'buyer_id', 'o_orderstatus', 'total_price', 'o_orderdate', 'o_orderpriority'] AS aliases,
  ['numeric', 'identifier', 'text', 'numeric', 'date', 'text'] AS kinds FROM orders""")
def column_profile(spark, root):
    o = _orders_text(spark, root)
    p = o.select("o_orderkey", x.profile(o).alias("p"))
    return p.select("o_orderkey", F.col("p.alias").alias("aliases"), F.col("p.kind").alias("kinds"))


@query("representative_columns", """
SELECT o_orderkey, 'o_orderpriority' AS entity_column, CASE WHEN o_orderkey % 2 = 0 THEN 'o_orderkey' ELSE 'TotalPrice' END AS metric_column,
  'o_orderdate' AS date_column, NULL::VARCHAR AS id_column FROM orders""")
def representative_columns(spark, root):
    o = _orders_text(spark, root)
    wanted = {"entity_column": ["name", "o_orderpriority"], "metric_column": ["Sales"], "date_column": ["o_orderdate"], "id_column": ["RowKey"]}
    odd = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("none")
    text = o.withColumns({"key": F.col("o_orderkey"), "o_orderkey": odd})
    chosen = x.representative_columns(x.row_map(text.drop("key")), o.columns, wanted)
    return text.select(F.col("key").alias("o_orderkey"), *[chosen.get(label, F.lit(None).cast("string")).alias(label) for label in wanted])


# JSON inputs of four shapes made from documents by rule.
ITEMS_SQL = """
SELECT doc_id, 1 AS position, 'snippet-1' AS id, text AS snippet FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 2, 'snippet-2', text FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 1, 'snippet-1', text FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 2, 'own', text FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 3, 'snippet-3', NULL FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 1, 'one', text FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 1, 'snippet-1', text FROM documents WHERE doc_id % 4 = 3"""


def _json_inputs(spark, root):
    text = x.json_text(F.col("text"))
    i = F.col("doc_id") % 4
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    json = (F.when(i == 0, say("[", text, ', {"code": ', text, "}]"))
            .when(i == 1, say('{"snippets": [{"snippet": " ", "code": ', text, '}, {"id": "own", "snippet": ', text, '}, {"id": null, "code": 5}]}'))
            .when(i == 2, say('{"id": "one", "snippet": ', text, "}")).otherwise(text))
    return table(spark, root, "documents", "doc_id").select("doc_id", F.parse_json(json).alias("json"))


@query("snippet_input_shapes", f"SELECT doc_id, CAST(position AS INTEGER) AS position FROM ({ITEMS_SQL})")
def snippet_input_shapes(spark, root):
    return x.snippet_items(_json_inputs(spark, root), "doc_id").select("doc_id", "position")


@query("snippet_normalize", f"""
SELECT doc_id, CAST(position AS INTEGER) AS position, id, CASE WHEN regexp_full_match(snippet, '[\\s\\pZ]*') THEN CASE WHEN doc_id % 4 = 3 OR (doc_id % 4 = 0 AND position = 1) THEN snippet END ELSE snippet END AS snippet,
  snippet IS NULL OR (regexp_full_match(snippet, '[\\s\\pZ]*') AND NOT (doc_id % 4 = 3 OR (doc_id % 4 = 0 AND position = 1))) AS rejected FROM ({ITEMS_SQL})""")
def snippet_normalize(spark, root):
    items = x.snippet_items(_json_inputs(spark, root), "doc_id")
    return x.normalized_snippets(items, F.col("position")).select("doc_id", "position", "id", "snippet", F.col("error").isNotNull().alias("rejected"))


# Input files of every kind made from documents by rule: lists, empty lists, JSON lines with blank and broken ones, texts, texts without
# a path, and blank texts.
FILES_SQL = f"""
SELECT doc_id, path, position, id, snippet, error FROM (
SELECT doc_id, 'in/' || doc_id || '.json' AS path, 'json' AS kind, 1 AS position, 'one' AS id, 'x ' || text AS snippet, NULL AS error FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'in/' || doc_id || '.json', 'json', 0, NULL, NULL, 'no snippets found' FROM documents WHERE doc_id % 7 = 1
UNION ALL SELECT doc_id, 'in/' || doc_id || '.jsonl', 'jsonl', 1, 'snippet-1', 'x ' || text, NULL FROM documents WHERE doc_id % 7 = 2
UNION ALL SELECT doc_id, 'in/' || doc_id || '.jsonl', 'jsonl', 3, 'snippet-3', NULL, 'invalid JSON' FROM documents WHERE doc_id % 7 = 2
UNION ALL SELECT doc_id, 'in/' || doc_id || '.jsonl', 'jsonl', 4, 'own', 'x ' || text, NULL FROM documents WHERE doc_id % 7 = 2
UNION ALL SELECT doc_id, 'in/deep.d/s' || doc_id || '.txt', 'text', 1, 's' || doc_id, regexp_replace('x ' || text, '[\\s\\pZ]+$', ''), NULL FROM documents WHERE doc_id % 7 = 3
UNION ALL SELECT doc_id, NULL, 'text', 1, 'snippet-1', regexp_replace('x ' || text, '[\\s\\pZ]+$', ''), NULL FROM documents WHERE doc_id % 7 = 4
UNION ALL SELECT doc_id, 'in/blank', 'text', 0, NULL, NULL, 'empty file' FROM documents WHERE doc_id % 7 = 5
UNION ALL SELECT doc_id, 'in/' || doc_id || '.json', 'json', 0, NULL, NULL, 'invalid JSON' FROM documents WHERE doc_id % 7 = 6)"""


@query("snippet_files", FILES_SQL)
def snippet_files(spark, root):
    i, text = F.col("doc_id") % 7, F.concat(F.lit("x "), F.col("text"))
    name, json = F.col("doc_id").cast("string"), x.json_text(text)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    path = (F.when(i == 2, say("in/", name, ".jsonl")).when(i == 3, say("in/deep.d/s", name, ".txt")).when(i == 4, F.lit(None))
            .when(i == 5, F.lit("in/blank")).otherwise(say("in/", name, ".json")))
    held = (F.when(i == 0, say('{"snippets": [{"id": "one", "code": ', json, "}]}")).when(i == 1, F.lit('{"snippets": []}'))
            .when(i == 2, say(json, "\r\n\n{broken\n", '{"id": "own", "snippet": ', json, "}\n")).when(i == 3, say("\n ", text, " \n"))
            .when(i == 4, text).when(i == 5, F.lit(" \n\t")).otherwise(say("[", json)))
    files = table(spark, root, "documents", "doc_id").select("doc_id", path.alias("path"), held.alias("text"))
    return x.load_snippets(files)
