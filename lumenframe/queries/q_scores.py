"""Answer scoring: each assistant turn against a gold answer made from the user turn before it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import scores as s
from ..plans.context import json_text
from ..session import table
from .registry import query

BLANKS = r"[\s\pZ]"
NORM = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^{BLANKS}+', ''), '{BLANKS}+$', ''), '{BLANKS}+', ' ', 'g')"
STRIP = lambda c: rf"regexp_replace(regexp_replace({c}, '^{BLANKS}+', ''), '{BLANKS}+$', '')"


@query("normalize_answer", f"SELECT doc_id, {NORM('text')} AS norm FROM documents")
def normalize_answer(spark, root):
    return table(spark, root, "documents", "doc_id").select("doc_id", s.normalized(F.col("text")).alias("norm"))


@query("extract_final_answer", f"""
SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN CASE WHEN contains(text, '</') THEN '' ELSE {STRIP('text')} END ELSE {STRIP('text')} END AS answer FROM conversations""")
def extract_final_answer(spark, root):
    text = F.col("text")
    wrapped = (F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<reasoning>a</reasoning>\n<Answer> "), text, F.lit("\n</ANSWER> <answer>b</answer>")))
               .otherwise(F.concat(F.lit(" \t"), text)))
    return table(spark, root, "conversations").select("conv_id", "turn", s.final_answer(wrapped).alias("answer"))


# By turn number the answer equals, holds, or misses the gold text, with or without tags.
PAIRS_SQL = """
p AS (SELECT a.conv_id, a.turn, q.text AS gold, a.turn % 8 AS k, CASE a.turn % 8
  WHEN 0 THEN a.text WHEN 1 THEN '<reasoning>x</reasoning><answer> ' || translate(q.text, 'aeiou', 'AEIOU') || '</answer>' WHEN 2 THEN '  '
  WHEN 3 THEN 'so: ' || q.text WHEN 4 THEN '<answer>' || a.text || '</answer>' WHEN 5 THEN q.text ELSE '<reasoning>' || a.text END AS completion
FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1)"""


def _pairs(spark, root):
    c = table(spark, root, "conversations")
    q = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    k, text, gold = F.col("turn") % 8, F.col("text"), F.col("gold")
    completion = (F.when(k == 0, text).when(k == 1, say("<reasoning>x</reasoning><answer> ", F.translate(gold, "aeiou", "AEIOU"), "</answer>")).when(k == 2, F.lit("  "))
                  .when(k == 3, say("so: ", gold)).when(k == 4, say("<answer>", text, "</answer>")).when(k == 5, gold).otherwise(say("<reasoning>", text)))
    made = c.join(q, ["conv_id", "turn"]).select("conv_id", "turn", json_text(F.col("gold")).alias("g"), json_text(completion).alias("c"))
    # Completions are texts, messages, lists of messages, or messages with structured content; gold answers texts or objects.
    k = F.col("conv_id") % 4
    shaped = (F.when(k == 0, F.col("c")).when(k == 1, say('{"role": "assistant", "content": ', F.col("c"), "}"))
              .when(k == 2, say('[{"role": "assistant", "content": ', F.col("c"), '}, ""]')).otherwise(say('[{"content": {"content": {"text": ', F.col("c"), "}}}]")))
    gold_shape = F.when(k % 2 == 0, F.col("g")).otherwise(say('{"text": ', F.col("g"), "}"))
    return made.select("conv_id", "turn", F.parse_json(gold_shape).alias("gold"), F.parse_json(shaped).alias("completion"))


SCORES_SQL = f"""
WITH {PAIRS_SQL}, n AS (SELECT *, {NORM("regexp_replace(regexp_replace(completion, '^<reasoning>x</reasoning><answer>', ''), '^<answer>|</answer>$', '', 'g')")} AS a, {NORM('gold')} AS g FROM p),
s AS (SELECT conv_id, turn, CAST(CASE WHEN k = 1 THEN 1.0 WHEN k = 4 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS format,
  CAST(CASE WHEN {STRIP('completion')} <> '' THEN 0.25 ELSE -0.25 END AS DOUBLE) AS non_empty,
  CAST(CASE WHEN a <> '' AND g <> '' AND (contains(a, g) OR contains(g, a)) THEN 0.5 ELSE 0.0 END AS DOUBLE) AS partial,
  CAST(CASE WHEN g <> '' AND a = g THEN 2.0 ELSE 0.0 END AS DOUBLE) AS exact FROM n)"""


def _scored(spark, root):
    return s.score_table(_pairs(spark, root), "completion", "gold")


@query("reward_exact", f"{SCORES_SQL} SELECT conv_id, turn, exact FROM s")
def reward_exact(spark, root):
    return _scored(spark, root).select("conv_id", "turn", "exact")


@query("reward_partial", f"{SCORES_SQL} SELECT conv_id, turn, partial FROM s")
def reward_partial(spark, root):
    return _scored(spark, root).select("conv_id", "turn", "partial")


@query("reward_format", f"{SCORES_SQL} SELECT conv_id, turn, format FROM s")
def reward_format(spark, root):
    return _scored(spark, root).select("conv_id", "turn", "format")


@query("reward_non_empty", f"{SCORES_SQL} SELECT conv_id, turn, non_empty FROM s")
def reward_non_empty(spark, root):
    return _scored(spark, root).select("conv_id", "turn", "non_empty")


@query("reward_table", f"{SCORES_SQL} SELECT *, format + non_empty + partial + exact AS total FROM s")
def reward_table(spark, root):
    return _scored(spark, root).select("conv_id", "turn", "format", "non_empty", "partial", "exact", "total")
