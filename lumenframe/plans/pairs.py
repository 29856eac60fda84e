"""Chat and schema pairs: validation, split into two training sets, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..operators.reshape import settle
from .requests import CODE_PROMPT, field, is_text, kind, spaced_json, text_of, turn

ROLES = ["system", "user", "assistant"]
MESSAGES = "array<struct<role:string,content:string>>"

# System prompts for pairs with a schema; one per training stage.
SFT_PROMPT = CODE_PROMPT
GRPO_PROMPT = (
    "Write your reasoning inside <reasoning>...</reasoning> and your final {library} code inside <answer>...</answer>. "
    "No markdown fences. Assign the final {library} DataFrame to result. "
)


def message_fault(message: Column, position: Column) -> Column:
    """First fault of one chat message given as a variant."""
    at = F.concat(F.lit("messages["), position.cast("string"), F.lit("]"))
    role = F.variant_get(message, "$.role", "string")
    return (F.when(~kind(message).startswith("OBJECT"), F.concat(at, F.lit(" must be an object")))
            .when(role.isNull() | ~role.isin(*ROLES), F.concat(at, F.lit(" has unsupported role")))
            .when(~is_text(field(message, "content")), F.concat(at, F.lit(" content must be a string"))))


def messages_error(record: Column) -> Column:
    """First fault of a record with `messages`, or null."""
    listed = field(record, "messages")
    items = F.when(kind(listed).startswith("ARRAY"), F.variant_get(record, "$.messages", "array<variant>"))
    faults = F.filter(F.transform(items, message_fault), lambda x: x.isNotNull())
    end = F.element_at(items, -1)
    answer = F.variant_get(end, "$.content", "string")
    return (F.when(listed.isNull(), F.lit("missing 'messages' field"))
            .when(items.isNull() | (F.size(items) == 0), F.lit("'messages' must be a non-empty list"))
            .when(F.size(faults) > 0, F.get(faults, F.lit(0)))
            .when(F.variant_get(end, "$.role", "string") != "assistant", F.lit("last message role must be 'assistant'"))
            .when(is_blank(answer), F.lit("last assistant message is empty")))


def validated(records: DataFrame, json: str = "json") -> DataFrame:
    """Add `error`, and typed `messages` for records without one."""
    v = F.col(json)
    known = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    out = settle(records, error=F.coalesce(known, messages_error(v)))
    return out.withColumn("messages", F.when(F.col("error").isNull(), F.variant_get(v, "$.messages", MESSAGES)))


def split_rows(valid: DataFrame, *keys: str) -> DataFrame:
    """Both training sets in one pass: `messages`, and `prompt` with `answer`."""
    m = F.col("messages")
    return valid.where("error is null").select(
        *keys, "messages", F.slice(m, F.lit(1), F.size(m) - 1).alias("prompt"), strip(F.element_at(m, -1)["content"]).alias("answer"))


def sft_rows(valid: DataFrame, *keys: str) -> DataFrame:
    return valid.where("error is null").select(*keys, "messages")


def grpo_rows(valid: DataFrame, *keys: str) -> DataFrame:
    """All messages but the last, and the last one's text as the answer."""
    return split_rows(valid, *keys).drop("messages")


def rejects(valid: DataFrame, *keys: str) -> DataFrame:
    return valid.where("error is not null").select(*keys, "error")


def counts(valid: DataFrame) -> DataFrame:
    good = F.count_if(F.col("error").isNull())
    return valid.agg(F.count(F.lit(1)).alias("input"), good.alias("sft"), good.alias("grpo"),
                     F.count_if(F.col("error").isNotNull()).alias("skipped"))


def turn_table_errors(turns: DataFrame, chat: str, order: str, role: str, content: str) -> DataFrame:
    """The same check for chats kept as one row per turn: first fault per chat.

    Only aggregates are formed, never lists, so a chat of any length is safe.
    """
    r, c = F.col(role), F.col(content)
    bad_role, bad_content = r.isNull() | ~r.isin(*ROLES), c.isNull()
    fault = F.when(bad_role, F.lit("unsupported role")).when(bad_content, F.lit("content must be a string"))
    per = turns.groupBy(chat).agg(
        F.min_by(fault, F.when(fault.isNotNull(), F.col(order))).alias("_fault"),
        F.max_by(F.struct(r.alias("r"), c.alias("c")), F.col(order)).alias("_end"), F.count(F.lit(1)).alias("turns"))
    error = (F.when(F.col("_fault").isNotNull(), F.col("_fault"))
             .when(F.col("_end.r") != "assistant", F.lit("last message role must be 'assistant'"))
             .when(is_blank(F.col("_end.c")), F.lit("last assistant message is empty")))
    return per.select(chat, "turns", error.alias("error"))


def schema_pair_error(record: Column) -> Column:
    """First fault of a record with question, schema and answer."""
    tests = [F.when(field(record, n).isNull(), F.lit(f"missing '{n}' field")) for n in ("question", "schema", "answer")]
    for n in ("question", "answer"):
        text = text_of(record, n)
        tests.append(F.when(text.isNull() | is_blank(text), F.lit(f"'{n}' must be a non-empty string")))
    tests.append(F.when(~kind(field(record, "schema")).startswith("ARRAY"), F.lit("'schema' must be a list")))
    return F.coalesce(*tests)


def has_contract_errors(record: Column) -> Column:
    """Whether a record reports contract errors: any value but nothing, null, false, 0, and an empty text, list or object."""
    path = "$.validation.contract_errors"
    said = F.variant_get(record, path, "variant")
    shown = F.to_json(said)
    return F.coalesce(~shown.isin("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}"), F.lit(False))


def schema_pairs(records: DataFrame, text: str, library: str, *, json: str = "json", keep_invalid: bool = False) -> DataFrame:
    """Add `error`, `fault`, `sft` messages, `grpo` prompt and `answer`.

    `text` is the raw line: the schema is shown in its own key order. `fault` leaves
    contract errors out of account.
    """
    v = F.col(json)
    known = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    fault = F.coalesce(known, schema_pair_error(v))
    error = F.col("fault")
    if not keep_invalid:
        error = F.coalesce(error, F.when(has_contract_errors(v), F.lit("contract errors")))
    segment = F.coalesce(F.variant_get(v, "$.segment_id", "string"), F.concat(F.lit("line-"), F.col("line").cast("string")))
    schema = spaced_json(F.get_json_object(F.col(text), "$.schema"))
    user = turn("user", strip(text_of(v, "question")))
    answer = strip(text_of(v, "answer"))
    system = lambda prompt: turn("system", F.concat(F.lit(prompt.format(library=library) + "Available schema: "), schema))
    ok = F.col("error").isNull()
    return (settle(settle(records, fault=fault), error=error).withColumn("segment_id", segment)
            .withColumn("sft", F.when(ok, F.array(system(SFT_PROMPT), user, turn("assistant", answer))))
            .withColumn("grpo", F.when(ok, F.array(system(GRPO_PROMPT), user)))
            .withColumn("answer", F.when(ok, answer)))


def merged(*sets: DataFrame) -> DataFrame:
    """Sets one after the other, with the rank of the set for ordering."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sets)]
    out = ranked[0]
    for other in ranked[1:]:
        out = out.unionByName(other)
    return out
