"""Requests, chat pairs and schema pairs: JSON records made from table rows by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import pairs as p
from ..plans import requests as r
from ..plans.context import TASK, json_text
from ..session import table
from ..sources.lines import first_error, parse_lines
from .registry import query


def say(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


# One record per turn. Kind n % 17 says what is wrong with it, if anything.
KIND = "(conv_id * 31 + turn) % 17"


def _chat_lines(spark, root):
    n = F.col("conv_id") * 31 + F.col("turn")
    k = n % 17
    text, role = json_text(F.col("text")), json_text(F.col("role"))
    ask = say('{"role": "user", "content": "turn ', F.col("turn").cast("string"), '"}')
    full = say('{"messages": [', ask, ', {"role": ', role, ', "content": ', text, "}]}")
    line = (F.when(k == 0, F.lit('{"chat": []}')).when(k == 1, F.lit('{"messages": []}'))
            .when(k == 2, say('{"messages": [', ask, ", ", text, "]}"))
            .when(k == 3, say('{"messages": [', ask, ', {"role": "assistant", "content": 5}]}'))
            .when(k == 4, say('{"messages": [{"role": "tool", "content": ', text, "}, ", ask, "]}"))
            .when(k == 5, F.substring(full, F.lit(1), F.char_length(full) - 2))
            .when(k == 6, say('{"messages": [', ask, ', {"role": "assistant", "content": " \\n "}]}')).otherwise(full))
    # The record number stands for the line number.
    return parse_lines(table(spark, root, "conversations").select(n.alias("line"), line.alias("value")))


ERROR_SQL = f"""CASE {KIND} WHEN 0 THEN 'missing ''messages'' field' WHEN 1 THEN '''messages'' must be a non-empty list' WHEN 2 THEN 'messages[1] must be an object'
  WHEN 3 THEN 'messages[1] content must be a string' WHEN 4 THEN 'messages[0] has unsupported role' WHEN 5 THEN 'invalid JSON'
  WHEN 6 THEN 'last assistant message is empty'
  ELSE CASE WHEN role <> 'assistant' THEN 'last message role must be ''assistant''' WHEN regexp_full_match(text, '[\\s\\pZ]*') THEN 'last assistant message is empty' END END"""
CHAT_SQL = f"WITH c AS (SELECT conv_id * 31 + turn AS line, turn, role, text, {ERROR_SQL} AS error FROM conversations)"


@query("pairs_validate", f"{CHAT_SQL} SELECT line, error FROM c")
def pairs_validate(spark, root):
    return p.validated(_chat_lines(spark, root)).select("line", "error")


@query("pairs_validate_turns", """
WITH e AS (SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text
  FROM conversations GROUP BY 1)
SELECT conv_id, turns, CASE WHEN last_role <> 'assistant' THEN 'last message role must be ''assistant''' END AS error FROM e""")
def pairs_validate_turns(spark, root):
    return p.turn_table_errors(table(spark, root, "conversations"), "conv_id", "turn", "role", "text")


@query("pairs_split", rf"""{CHAT_SQL}
SELECT line, 'turn ' || turn AS question, CAST(2 AS INTEGER) AS sft_size, text AS sft_last, CAST(1 AS INTEGER) AS prompt_size,
  regexp_replace(regexp_replace(text, '^[\s\pZ]+', ''), '[\s\pZ]+$', '') AS answer FROM c WHERE error IS NULL""")
def pairs_split(spark, root):
    both = p.split_rows(p.validated(_chat_lines(spark, root)), "line")
    return both.select("line", F.get("prompt", F.lit(0))["content"].alias("question"), F.size("messages").alias("sft_size"),
                       F.element_at("messages", -1)["content"].alias("sft_last"), F.size("prompt").alias("prompt_size"), "answer")


@query("pairs_rejects", f"""{CHAT_SQL}
SELECT line, error, line = (SELECT min(line) FROM c WHERE error IS NOT NULL) AS is_first FROM c WHERE error IS NOT NULL""")
def pairs_rejects(spark, root):
    valid = p.validated(_chat_lines(spark, root))
    first = first_error(valid).select(F.col("line").alias("_first"))
    return p.rejects(valid, "line").crossJoin(F.broadcast(first)).select("line", "error", (F.col("line") == F.col("_first")).alias("is_first"))


@query("pairs_counts", f"""{CHAT_SQL}
SELECT count(*) AS input, count(*) FILTER (WHERE error IS NULL) AS sft, count(*) FILTER (WHERE error IS NULL) AS grpo,
  count(*) FILTER (WHERE error IS NOT NULL) AS skipped FROM c""")
def pairs_counts(spark, root):
    return p.counts(p.validated(_chat_lines(spark, root)))


@query("request_validate", """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'missing ''message''' WHEN 1 THEN 'missing ''tables''' WHEN 2 THEN 'field ''message'' must be a non-empty string'
  WHEN 3 THEN 'field ''message'' must be a non-empty string' WHEN 4 THEN 'field ''tables'' must be a JSON object' WHEN 5 THEN 'must be a JSON object'
  WHEN 6 THEN 'invalid JSON' ELSE CASE WHEN regexp_full_match(text, '[\\s\\pZ]*') THEN 'field ''message'' must be a non-empty string' END END AS error FROM documents""")
def request_validate(spark, root):
    k, text = F.col("doc_id") % 8, json_text(F.col("text"))
    line = (F.when(k == 0, F.lit('{"tables": {}}')).when(k == 1, say('{"message": ', text, "}"))
            .when(k == 2, F.lit('{"message": 5, "tables": {}}')).when(k == 3, F.lit('{"message": " \\t", "tables": {}}'))
            .when(k == 4, F.lit('{"message": "x", "tables": [1]}')).when(k == 5, say("[", text, "]"))
            .when(k == 6, say('{"message": ', text)).otherwise(say('{"message": ', text, ', "tables": {"t": {"a": "int"}}}')))
    parsed = parse_lines(table(spark, root, "documents", "doc_id").select("doc_id", line.alias("value")))
    return r.with_request_errors(parsed).select("doc_id", "error")


LIBRARY = "Spark"
PLAIN_PROMPT = r.CODE_PROMPT.format(library=LIBRARY)
SYSTEM_SQL = f"""CASE WHEN doc_id % 2 = 0 THEN '{r.SNIPPET_PROMPT}Available context: {{"__task": "{TASK}", "source": "' || source || '", "n": [1, 2, ' || doc_id || ']}}'
  ELSE '{PLAIN_PROMPT}Available datasets: {{"' || source || '": {{"a, b: c": "' || lang || '"}}}}' END"""


def _prompts(spark, root):
    tables = F.when(F.col("doc_id") % 2 == 0, say(f'{{"__task":"{TASK}","source":"', F.col("source"), '","n":[1,2,', F.col("doc_id").cast("string"), "]}")).otherwise(
        say('{"', F.col("source"), '": {"a, b: c":"', F.col("lang"), '"}}'))
    return table(spark, root, "documents", "doc_id").withColumn("system", r.system_prompt(tables, LIBRARY))


@query("system_prompt_select", f"SELECT doc_id, {SYSTEM_SQL} AS system FROM documents")
def system_prompt_select(spark, root):
    return _prompts(spark, root).select("doc_id", "system")


@query("chat_messages", f"SELECT doc_id, [{{'role': 'system', 'content': {SYSTEM_SQL}}}, {{'role': 'user', 'content': text}}] AS messages FROM documents")
def chat_messages(spark, root):
    return _prompts(spark, root).select("doc_id", r.chat(F.col("system"), F.col("text")).alias("messages"))


# Schema pairs made from documents; kind doc_id % 11 says what is wrong, if anything.
def _schema_lines(spark, root):
    k, text = F.col("doc_id") % 11, json_text(F.col("text"))
    schema = say('[{"name":"', F.col("source"), '","dtype":"str","non_null_sample":"a, b: c"}]')
    full = lambda q, s, a, more="": say('{"question":', q, ',"schema":', s, ',"answer":', a, more, "}")
    ask = F.lit('"  how many rows?\\n"')
    line = (F.when(k == 0, say('{"schema":', schema, ',"answer":', text, "}")).when(k == 1, say('{"question":', ask, ',"answer":', text, "}"))
            .when(k == 2, full(F.lit("7"), schema, text)).when(k == 3, full(ask, schema, F.lit('"  "')))
            .when(k == 4, full(ask, F.lit('{"a":1}'), text))
            .when(k == 5, full(ask, schema, text, ',"validation":{"contract_errors":["no result"]}'))
            .when(k == 6, full(ask, schema, text, ',"validation":{"contract_errors":[]},"segment_id":"own"')).otherwise(full(ask, schema, text)))
    return parse_lines(table(spark, root, "documents", "doc_id").select(F.col("doc_id").alias("line"), line.alias("value")))


SCHEMA_ERROR = """CASE doc_id % 11 WHEN 0 THEN 'missing ''question'' field' WHEN 1 THEN 'missing ''schema'' field' WHEN 2 THEN '''question'' must be a non-empty string'
  WHEN 3 THEN '''answer'' must be a non-empty string' ELSE CASE WHEN regexp_full_match(text, '[\\s\\pZ]*') THEN '''answer'' must be a non-empty string'
  WHEN doc_id % 11 = 4 THEN '''schema'' must be a list' END END"""


@query("schema_pairs_validate", f"SELECT doc_id AS line, {SCHEMA_ERROR} AS error FROM documents")
def schema_pairs_validate(spark, root):
    return _schema_lines(spark, root).select("line", p.schema_pair_error(F.col("json")).alias("error"))


@query("contract_filter", f"""
SELECT doc_id AS line, CASE WHEN doc_id % 11 = 6 THEN 'own' ELSE 'line-' || doc_id END AS segment_id,
  coalesce({SCHEMA_ERROR}, CASE WHEN doc_id % 11 = 5 THEN 'contract errors' END) AS error, {SCHEMA_ERROR} AS error_kept FROM documents""")
def contract_filter(spark, root):
    return p.schema_pairs(_schema_lines(spark, root), "value", LIBRARY).select("line", "segment_id", "error", F.col("fault").alias("error_kept"))


STRIPPED = r"regexp_replace(regexp_replace(text, '^[\s\pZ]+', ''), '[\s\pZ]+$', '')"
SCHEMA_TEXT = """'Available schema: [{"name": "' || source || '", "dtype": "str", "non_null_sample": "a, b: c"}]'"""


@query("schema_prompt", f"""
SELECT doc_id AS line, '{p.SFT_PROMPT.format(library=LIBRARY)}' || {SCHEMA_TEXT} AS sft_system, '{p.GRPO_PROMPT.format(library=LIBRARY)}' || {SCHEMA_TEXT} AS grpo_system,
  'how many rows?' AS question, {STRIPPED} AS answer FROM documents WHERE ({SCHEMA_ERROR}) IS NULL AND doc_id % 11 <> 5""")
def schema_prompt(spark, root):
    made = p.schema_pairs(_schema_lines(spark, root), "value", LIBRARY).where("error IS NULL")
    at = lambda c, i: F.get(c, F.lit(i))["content"]
    return made.select("line", at("sft", 0).alias("sft_system"), at("grpo", 0).alias("grpo_system"), at("sft", 1).alias("question"), "answer")


@query("merge_sets", f"""{CHAT_SQL}
SELECT 0 AS source_rank, CAST(3 AS INTEGER) AS size, 'how many rows?' AS question, {STRIPPED} AS answer FROM documents WHERE ({SCHEMA_ERROR}) IS NULL AND doc_id % 11 <> 5
UNION ALL SELECT 1, 2, 'turn ' || turn, text FROM c WHERE error IS NULL""")
def merge_sets(spark, root):
    schema = p.schema_pairs(_schema_lines(spark, root), "value", LIBRARY).where("error IS NULL").select(F.col("sft").alias("messages"))
    both = p.merged(schema, p.sft_rows(p.validated(_chat_lines(spark, root))))
    m = F.col("messages")
    return both.select("source_rank", F.size(m).alias("size"), F.element_at(m, -2)["content"].alias("question"), F.element_at(m, -1)["content"].alias("answer"))
