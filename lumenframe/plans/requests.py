"""Data side of batch generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .context import TASK

# System prompts. The first is for code of a given library.
CODE_PROMPT = "Return only valid Python {library} code. No markdown fences. Assign the final {library} DataFrame to result. "
SNIPPET_PROMPT = (
    "Return only the contextualized snippet text. No markdown fences. "
    "Preserve the original snippet intent and most of its structure. "
    "Replace generic placeholders with concrete column names, variable names, and values from the provided CSV row context. "
    "Use only columns and values that exist in the provided context. "
)


def field(record: Column, name: str) -> Column:
    return F.variant_get(record, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """Type name of a variant; null for a missing field."""
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def text_of(record: Column, name: str) -> Column:
    """A field that is text, else null."""
    return F.when(is_text(field(record, name)), F.variant_get(record, f"$.{name}", "string"))


def request_error(record: Column, prompt: str = "message", tables: str = "tables") -> Column:
    """First fault of a request, or null: a non-blank prompt text and a tables object."""
    p, t = field(record, prompt), field(record, tables)
    text = text_of(record, prompt)
    return (F.when(p.isNull(), F.lit(f"missing '{prompt}'")).when(t.isNull(), F.lit(f"missing '{tables}'"))
            .when(text.isNull() | is_blank(text), F.lit(f"field '{prompt}' must be a non-empty string"))
            .when(~kind(t).startswith("OBJECT"), F.lit(f"field '{tables}' must be a JSON object")))


def spaced_json(c: Column) -> Column:
    """Compact JSON with a space after each comma and colon outside of texts."""
    pieces = F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]|\\.)*+"|[,:]|[^",:]+'), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.isin(",", ":"), F.concat(p, F.lit(" "))).otherwise(p)), "")


def system_prompt(tables: Column, library: str) -> Column:
    """System text for a tables object given as JSON text; the task mark picks it."""
    shown = spaced_json(F.get_json_object(tables, "$"))
    task = F.get_json_object(tables, "$.__task")
    code = CODE_PROMPT.format(library=library)
    return F.when(task == TASK, F.concat(F.lit(SNIPPET_PROMPT + "Available context: "), shown)).otherwise(
        F.concat(F.lit(code + "Available datasets: "), shown))


def turn(role: Column | str, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def chat(system: Column, user: Column) -> Column:
    return F.array(turn("system", system), turn("user", user))


def with_request_errors(records: DataFrame, json: str = "json") -> DataFrame:
    """Keep the parse error of a line, else add its request error."""
    return records.withColumn("error", F.coalesce(F.col("error"), request_error(F.col(json))))
