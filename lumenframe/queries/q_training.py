"""Training set normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import training_sets as ts
from ..plans.context import json_text
from ..plans.requests import turn
from ..operators.reshape import settle
from ..session import table
from .q_pairs import say
from .registry import query

BLANKS = r"[\s\pZ]"
STRIP = lambda c: rf"regexp_replace(regexp_replace({c}, '^{BLANKS}+', ''), '{BLANKS}+$', '')"


@query("content_to_text", f"""
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text
  WHEN 3 THEN {STRIP("CASE WHEN text = '' THEN 'more' ELSE text || chr(10) || 'more' END")} WHEN 4 THEN '' WHEN 5 THEN '{{"x":1}}' WHEN 6 THEN '12' ELSE text END AS text FROM documents""")
def content_to_text(spark, root):
    k, text = F.col("doc_id") % 8, json_text(F.col("text"))
    json = (F.when(k == 0, text).when(k == 1, say('{"text": ', text, "}")).when(k == 2, say('{"content": {"text": ', text, "}}"))
            .when(k == 3, say("[", text, ', {"type": "text", "text": "more"}, {"type": "image", "url": "u"}, {"content": {"text": ""}}, 5]'))
            .when(k == 4, F.lit("null")).when(k == 5, F.lit('{"x": 1}')).when(k == 6, F.lit("12"))
            .otherwise(say('{"content": {"content": {"content": {"content": ', text, "}}}}")))
    parsed = settle(table(spark, root, "documents", "doc_id").select("doc_id", json.alias("value")), v=F.parse_json("value"))
    return parsed.select("doc_id", ts.content_to_text(F.col("v")).alias("text"))


def _shaped(text, number):
    """Content in one of five shapes: text, a list of a text part, objects, a list of a text, deep objects."""
    k, t = number % 5, json_text(text)
    json = (F.when(k == 0, t).when(k == 1, say('[{"type": "text", "text": ', t, "}]")).when(k == 2, say('{"content": {"text": ', t, "}}"))
            .when(k == 3, say("[", t, "]")).otherwise(say('{"content": {"content": {"content": {"content": {"text": ', t, "}}}}}")))
    return F.parse_json(json)


TURNS = "'<|turn>system' || chr(10) || {s} || '<turn|>' || chr(10) || '<|turn>user' || chr(10) || {u} || '<turn|>' || chr(10) || '<|turn>model' || chr(10) || {a} || '<turn|>'"
NO_SYSTEM = "'<|turn>user' || chr(10) || {u} || '<turn|>' || chr(10) || '<|turn>model' || chr(10) || {a} || '<turn|>'"


def _chats(spark, root):
    """Chats of three messages, one per turn of `conversations`."""
    c = table(spark, root, "conversations")
    chat = F.array(turn("system", F.concat(F.lit("chat "), F.col("conv_id").cast("string"))),
                   turn("user", F.concat(F.lit("turn "), F.col("turn").cast("string"))), turn("assistant", F.col("text")))
    return c.select("conv_id", "turn", chat.alias("messages"))


CHAT_TEXT = TURNS.format(s="('chat ' || conv_id)", u="('turn ' || turn)", a="text")


@query("render_turns", f"SELECT conv_id, turn, {CHAT_TEXT} AS text FROM conversations")
def render_turns(spark, root):
    return _chats(spark, root).select("conv_id", "turn", ts.render_turns(F.col("messages")).alias("text"))


@query("strip_bos", f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<bos>' ELSE '' END || {CHAT_TEXT} AS text FROM conversations")
def strip_bos(spark, root):
    marks = F.repeat(F.lit("<bos>"), F.when(F.col("turn") % 3 == 0, 2).otherwise(F.col("turn") % 3 - 1).cast("int"))
    made = _chats(spark, root).select("conv_id", "turn", F.concat(marks, ts.render_turns(F.col("messages"))).alias("text"))
    return made.withColumn("text", ts.strip_bos(F.col("text")))


@query("sft_formats", f"""
SELECT 'messages' AS shape, conv_id * 31 + turn AS row_id, {CHAT_TEXT} AS text FROM conversations
UNION ALL SELECT 'conversations', conv_id * 31 + turn, {CHAT_TEXT} FROM conversations
UNION ALL SELECT 'pair', doc_id, CASE WHEN doc_id % 2 = 0 THEN {TURNS.format(s='lang', u='source', a='text')} ELSE {TURNS.format(s="'be brief'", u='source', a='text')} END FROM documents
UNION ALL SELECT 'bare', doc_id, {NO_SYSTEM.format(u='source', a='text')} FROM documents
UNION ALL SELECT 'shapes', doc_id, {TURNS.format(s="'be brief'", u='source', a='answer')} FROM (SELECT *, CASE WHEN doc_id % 5 IN (1, 3) THEN {STRIP('text')} ELSE text END AS answer FROM documents)
UNION ALL SELECT 'parts', conv_id * 31 + turn, {CHAT_TEXT} FROM conversations
UNION ALL SELECT 'text', doc_id, text FROM documents""")
def sft_formats(spark, root):
    chats = _chats(spark, root).withColumn("row_id", F.col("conv_id") * 31 + F.col("turn"))
    d = table(spark, root, "documents", "doc_id").withColumnRenamed("doc_id", "row_id")
    pair = d.select("row_id", F.col("source").alias("prompt"), F.col("text").alias("response"), F.when(F.col("row_id") % 2 == 0, F.col("lang")).alias("system"))
    sets = {
        "messages": ts.sft_text(chats), "conversations": ts.sft_text(chats.withColumnRenamed("messages", "conversations")),
        "pair": ts.sft_text(pair, system="be brief", system_field="system"), "bare": ts.sft_text(pair.drop("system")), "text": ts.sft_text(d),
        "shapes": ts.sft_text(pair.select("row_id", F.struct(F.col("prompt").alias("text")).alias("prompt"), _shaped(F.col("response"), F.col("row_id")).alias("response")), system="be brief"),
        "parts": ts.sft_text(chats.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.struct(m["content"].alias("text")).alias("content"))))),
    }
    out = None
    for shape, made in sets.items():
        part = made.select(F.lit(shape).alias("shape"), "row_id", "text")
        out = part if out is None else out.unionByName(part)
    return out


# By rule an earlier assistant turn holds a mark of hidden reasoning, or a role is foreign.
@query("history_validate", """
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'unsupported role' WHEN turn % 5 IN (1, 2) THEN 'thoughts in an earlier assistant turn' END AS error FROM conversations""")
def history_validate(spark, root):
    k, text = F.col("turn") % 5, F.col("text")
    early = F.when(k == 1, F.concat(F.lit("<Reasoning>why"), text)).when(k == 2, F.concat(text, F.lit("<|channel>thought"))).otherwise(text)
    first = turn(F.when(k == 4, F.lit("tool")).otherwise(F.lit("user")), text)
    three = F.array(first, turn("assistant", early), turn("assistant", F.concat(F.lit("<answer>"), text)))
    two = F.array(turn("assistant", F.lit("<answer>x</answer>")), turn("user", text))
    return table(spark, root, "conversations").select("conv_id", "turn", ts.history_error(F.when(k == 0, two).otherwise(three)).alias("error"))


@query("grpo_formats", """
SELECT 'messages' AS shape, conv_id * 31 + turn AS row_id, CAST(2 AS INTEGER) AS size, 'chat ' || conv_id AS system, text AS answer FROM conversations
UNION ALL SELECT 'explicit', conv_id * 31 + turn, 2, 'chat ' || conv_id, CASE WHEN turn % 2 = 0 THEN 'own' ELSE text END FROM conversations
UNION ALL SELECT 'pair', doc_id, 2, 'think first', text FROM documents
UNION ALL SELECT 'chat', doc_id, 1, 'role of the user', text FROM documents""")
def grpo_formats(spark, root):
    chats = _chats(spark, root).withColumn("row_id", F.col("conv_id") * 31 + F.col("turn"))
    d = table(spark, root, "documents", "doc_id").select(F.col("doc_id").alias("row_id"), F.col("source").alias("prompt"), F.col("text").alias("answer"))
    led = d.withColumn("prompt", F.array(turn("system", F.lit("role of the user"))))
    own = chats.withColumn("answer", F.when(F.col("turn") % 2 == 0, F.lit("own")).otherwise(F.lit("")))
    sets = {"messages": ts.grpo_set(chats), "explicit": ts.grpo_set(own), "pair": ts.grpo_set(d, system="think first"), "chat": ts.grpo_set(led)}
    out = None
    for shape, made in sets.items():
        part = made.select(F.lit(shape).alias("shape"), "row_id", F.size("prompt").alias("size"),
                           F.get("prompt", F.lit(0))["content"].alias("system"), "answer")
        out = part if out is None else out.unionByName(part)
    return out


@query("gold_validate", f"""
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'empty gold answer' WHEN turn % 4 = 1 THEN 'reasoning in the gold answer'
  WHEN regexp_full_match(text, '{BLANKS}*') THEN 'empty gold answer' END AS error FROM conversations""")
def gold_validate(spark, root):
    k = F.col("turn") % 4
    gold = F.when(k == 0, F.lit(" \n")).when(k == 1, F.concat("text", F.lit("<ANSWER>"))).otherwise(F.col("text"))
    return table(spark, root, "conversations").select("conv_id", "turn", ts.gold_error(gold).alias("error"))


@query("token_length_estimate", f"""
SELECT CAST(max(len(list_filter(regexp_split_to_array(text, '{BLANKS}+'), lambda w: w <> ''))) AS BIGINT) AS max_words,
  CAST(100000 - max(len(list_filter(regexp_split_to_array(text, '{BLANKS}+'), lambda w: w <> ''))) - 1 AS BIGINT) AS room
FROM documents""")
def token_length_estimate(spark, root):
    return ts.longest_prompt_words(table(spark, root, "documents", "doc_id"), "text", 100_000)
