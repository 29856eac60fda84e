"""Bring training rows of several shapes to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.content import completion_to_text, content_to_text
from ..functions.text import is_blank
from .requests import kind, turn

# Marks of hidden reasoning, and the roles allowed in a chat.
THOUGHT_MARKS = [
    "<reasoning>", "</reasoning>", "<answer>", "</answer>", "<|think|>", "<|channel>thought", "<channel|>",
]
ROLES = ["system", "user", "assistant"]

# Fixed value: the default system text for rows with a gold answer.
GOLD_PROMPT = (
    "You are a careful reasoning assistant. Write your reasoning inside <reasoning>...</reasoning> "
    "and your final answer inside <answer>...</answer>."
)


def as_variant(df: DataFrame, name: str) -> Column:
    """A column of any type as a variant; a variant stays."""
    kind_ = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind_, T.VariantType):
        return c
    return F.to_variant_object(c) if isinstance(kind_, (T.ArrayType, T.StructType, T.MapType)) else c.cast("variant")


def text_column(df: DataFrame, name: str) -> Column:
    """A content column of any type as text; null as ''."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(F.col(f"`{name}`"), F.lit(""))
    return F.coalesce(content_to_text(as_variant(df, name)), F.lit(""))


CHAT = "array<struct<role:string,content:string>>"


def chat_column(df: DataFrame, name: str) -> Column:
    """Messages of any form (typed, with structured content, or a variant) as roles and texts."""
    if df.schema[name].dataType.simpleString() == CHAT:
        return F.col(f"`{name}`")
    return chat_of(as_variant(df, name))


def chat_of(v: Column) -> Column:
    """A variant list of messages as roles and texts, content of any depth flattened."""
    items = F.when(kind(v).startswith("ARRAY"), F.variant_get(v, "$", "array<variant>"))
    return F.transform(items, lambda m: F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), content_to_text(F.try_variant_get(m, "$.content", "variant")).alias("content")))


def completion_column(df: DataFrame, name: str) -> Column:
    """A completion column of any type as text; null as ''."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(F.col(f"`{name}`"), F.lit(""))
    return F.coalesce(completion_to_text(as_variant(df, name)), F.lit(""))


def render_turns(messages: Column) -> Column:
    """Messages as turn text; the assistant is shown as `model`."""
    shown = lambda m: F.concat(F.lit("<|turn>"), F.when(m["role"] == "assistant", F.lit("model")).otherwise(m["role"]),
                               F.lit("\n"), m["content"], F.lit("<turn|>"))
    return F.array_join(F.transform(messages, shown), "\n")


def strip_bos(text: Column, mark: str = "<bos>") -> Column:
    """Remove one leading mark of the start of a sequence."""
    return F.when(text.startswith(mark), F.substring(text, len(mark) + 1, 2_147_483_647)).otherwise(text)


def has_thoughts(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for mark in THOUGHT_MARKS:
        out = out | low.contains(mark)
    return out


def history_error(messages: Column) -> Column:
    """First fault of a chat: a foreign role or, from three messages on, hidden
    reasoning in an assistant turn before the last."""
    foreign = F.exists(messages, lambda m: m["role"].isNull() | ~m["role"].isin(*ROLES))
    earlier = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    thought = F.exists(earlier, lambda m: (m["role"] == "assistant") & has_thoughts(m["content"]))
    return (F.when(foreign, F.lit("unsupported role"))
            .when((F.size(messages) >= 3) & thought, F.lit("thoughts in an earlier assistant turn")))


def sft_text(df: DataFrame, *, system: str | None = None, system_field: str | None = None, prompt: str = "prompt",
             response: str = "response", messages: str = "messages", text: str = "text") -> DataFrame:
    """Add `text` and `error`, from whichever of the four shapes the columns show."""
    if text in df.columns:
        return df.withColumn("error", F.lit(None).cast("string"))
    if messages in df.columns or "conversations" in df.columns:
        chat = chat_column(df, messages if messages in df.columns else "conversations")
    else:
        chat = prompt_chat(df, system, system_field, prompt, response)
    out = df.withColumn("_chat", chat)
    out = out.withColumn("error", history_error(F.col("_chat")))
    return out.withColumn("text", F.when(F.col("error").isNull(), strip_bos(render_turns(F.col("_chat"))))).drop("_chat")


def prompt_chat(df: DataFrame, system: str | None, system_field: str | None, prompt: str, response: str) -> Column:
    own = F.nullif(text_column(df, system_field), F.lit("")) if system_field and system_field in df.columns else F.lit(None).cast("string")
    given = F.coalesce(own, F.lit(system or None).cast("string"))
    pair = F.array(turn("user", text_column(df, prompt)), turn("assistant", text_column(df, response)))
    return F.when(given.isNull() | (given == ""), pair).otherwise(F.concat(F.array(turn("system", given)), pair))


def grpo_set(df: DataFrame, *, system: str | None = GOLD_PROMPT, prompt: str = "prompt", answer: str = "answer",
             messages: str = "messages") -> DataFrame:
    """Add `prompt`, `answer` and `error` from messages or from prompt and answer."""
    have = set(df.columns)
    if messages not in have and not {prompt, answer} <= have:
        raise ValueError("needs prompt and answer, or messages")
    if messages in have:
        df = df.withColumn("_messages", chat_column(df, messages))
        m = F.col("_messages")
        ends = F.coalesce(F.element_at(F.when(F.size(m) > 0, m), -1)["role"] == "assistant", F.lit(False))
        turns = F.when(ends, F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
        gold = F.when(ends, F.element_at(m, -1)["content"]).otherwise(F.lit(""))
        if answer in have:
            gold = F.coalesce(F.nullif(text_column(df, answer), F.lit("")), gold)
    else:
        is_chat = df.schema[prompt].dataType.typeName() == "array"
        turns = chat_column(df, prompt) if is_chat else F.array(turn("user", text_column(df, prompt)))
        gold = text_column(df, answer)
    out = df.withColumn("_turns", turns).withColumn("_gold", gold)
    if system:
        led = F.coalesce(F.get(F.col("_turns"), F.lit(0))["role"] == "system", F.lit(False))
        full = F.when(led, F.col("_turns")).otherwise(F.concat(F.array(turn("system", F.lit(system))), F.col("_turns")))
        out = out.withColumn("_turns", full)
    error = F.coalesce(history_error(F.col("_turns")), gold_error(F.col("_gold")))
    drop = [*(c for c in (prompt, answer, messages) if c in have), "_messages"]
    return out.withColumn("error", error).drop(*drop).withColumnsRenamed({"_turns": "prompt", "_gold": "answer"})


def gold_error(answer: Column) -> Column:
    return (F.when(is_blank(answer), F.lit("empty gold answer"))
            .when(has_thoughts(answer), F.lit("reasoning in the gold answer")))


def longest_prompt_words(df: DataFrame, text: str, context: int) -> DataFrame:
    """Most words of any row, and the room left for an answer. Counts words, not model
    tokens; fewer than 32 left is an error."""
    words = F.size(F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != ""))
    most = df.agg(F.coalesce(F.max(words), F.lit(0)).cast("bigint").alias("max_words"))
    left = F.lit(context) - F.col("max_words") - 1
    return most.withColumn("room", F.when(left >= 32, left).otherwise(
        F.raise_error(F.lit("prompts leave fewer than 32 words for an answer")).cast("bigint")))
