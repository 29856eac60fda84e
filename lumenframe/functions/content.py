"""Nested content as text, by a walk over variants in column functions.

The walk keeps a frontier of open values. Each pass classifies all of them and replaces lists and objects by what they hold, one
level further down; each level keeps its texts and, for every value, the place of its parent. A second run goes back up: a list
is joined from the values whose parent it is. The number of passes is the depth of the row's own JSON, so flat rows take one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: How a value is read: as content, as a part of a content list, or as a completion.
CONTENT, PART, COMPLETION = range(3)
#: What a value turns out to be: a text, a wrapper of one value, or a list.
TEXT, WRAPPER, LIST = range(3)
CHILD = "array<struct<v:variant,mode:int>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nesting(json: Column) -> Column:
    """Depth of lists and objects in a JSON text."""
    marks = F.regexp_replace(F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]+", "")
    opened = F.translate(marks, "{}", "[]")

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark == "[", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.when(opened == "", 0).otherwise(F.aggregate(F.split(opened, "(?<=.)"), start, lambda a, m: F.when(m == "", a).otherwise(step(a, m)), lambda a: a["most"]))


def _shown(v: Column) -> Column:
    """A value as text: booleans with a capital, lists and objects as JSON."""
    text = F.variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _classified(item: Column) -> Column:
    """Text, kind and held values of one open value."""
    v, mode = item["v"], item["mode"]
    as_list = F.try_variant_get(v, "$", "array<variant>")
    fields = F.try_variant_get(v, "$", "map<string,variant>")

    def made(text, kind: int, held=None) -> Column:
        return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(kind).alias("kind"), (F.array() if held is None else held).cast(CHILD).alias("held"))

    def child(value: Column, as_: Column | int) -> Column:
        return F.struct(value.alias("v"), (F.lit(as_) if isinstance(as_, int) else as_).cast("int").alias("mode"))

    none = F.lit(None).cast("string")

    def read(found: Column) -> Column:
        items, entries = found["items"], found["entries"]
        one = lambda key: F.array(child(F.element_at(entries, F.lit(key)), CONTENT))
        has = lambda key: F.map_contains_key(entries, F.lit(key))
        typed = F.coalesce(F.try_variant_get(F.try_element_at(entries, F.lit("type")), "$", "string") == "text", F.lit(False))
        part_mode = F.when(mode == COMPLETION, COMPLETION).otherwise(PART)
        return (F.when(v.isNull() | F.is_variant_null(v), made(none, TEXT))
                .when(entries.isNotNull() & (mode == PART) & typed, made(_shown(F.try_element_at(entries, F.lit("text"))), TEXT))
                .when(entries.isNotNull() & (mode == CONTENT) & has("text"), made(none, WRAPPER, one("text")))
                .when(entries.isNotNull() & has("content"), made(none, WRAPPER, one("content")))
                .when(entries.isNotNull() & (mode == COMPLETION) & has("text"), made(none, WRAPPER, one("text")))
                .when(entries.isNotNull() & (mode == PART), made(none, TEXT))
                .when(items.isNotNull() & (mode == PART), made(none, TEXT))
                .when(items.isNotNull(), made(none, LIST, F.transform(items, lambda x: child(x, part_mode))))
                .when((mode == PART) & (F.schema_of_variant(v) != "STRING"), made(none, TEXT))
                .otherwise(made(_shown(v), TEXT)))

    return _let(F.struct(as_list.alias("items"), fields.alias("entries")), read)


LEVEL = "struct<parents:array<int>,nodes:array<struct<text:string,kind:int,n:int>>>"


def _walk(v: Column, mode: int, depth: Column) -> Column:
    def down(acc: Column, _: Column) -> Column:
        def widen(nodes: Column) -> Column:
            level = F.struct(acc["parents"].alias("parents"), F.transform(nodes, lambda x: F.struct(
                x["text"].alias("text"), x["kind"].alias("kind"), F.size(x["held"]).alias("n"))).alias("nodes")).cast(LEVEL)
            return F.struct(
                F.concat(acc["levels"], F.array(level)).alias("levels"), F.flatten(F.transform(nodes, lambda x: x["held"])).alias("open"),
                F.flatten(F.transform(nodes, lambda x, i: F.array_repeat(i, F.size(x["held"])))).alias("parents"))
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(_let(F.transform(acc["open"], _classified), widen))

    first = F.struct(F.array().cast(f"array<{LEVEL}>").alias("levels"), F.array(F.struct(v.alias("v"), F.lit(mode).alias("mode"))).cast(CHILD).alias("open"),
                     F.array(F.lit(0)).alias("parents"))

    def up(below: Column, level: Column) -> Column:
        def text(x: Column, i: Column) -> Column:
            held = F.slice(below["texts"], F.greatest(F.array_position(below["parents"], i).cast("int"), F.lit(1)), x["n"])
            joined = strip(F.array_join(F.filter(held, lambda t: t != ""), "\n"))
            return F.when(x["kind"] == TEXT, x["text"]).when(x["kind"] == WRAPPER, F.get(held, F.lit(0))).otherwise(joined)
        return F.struct(level["parents"].alias("parents"), F.transform(level["nodes"], text).alias("texts"))

    nothing = F.struct(F.array().cast("array<int>").alias("parents"), F.array().cast("array<string>").alias("texts"))
    levels = F.aggregate(F.sequence(F.lit(0), depth), first, down, lambda a: F.reverse(a["levels"]))
    return F.aggregate(levels, nothing, up, lambda a: F.get(a["texts"], F.lit(0)))


def _as_text(v: Column, mode: int) -> Column:
    # Most content is missing, a text, or an object that holds one directly: no walk for these.
    kind = F.schema_of_variant(v)
    field = lambda key: F.try_variant_get(v, f"$.{key}", "variant")
    first, second = ("text", "content") if mode == CONTENT else ("content", "text")
    direct = F.when(F.schema_of_variant(field(first)) == "STRING", F.variant_get(v, f"$.{first}", "string")).when(
        field(first).isNull() & (F.schema_of_variant(field(second)) == "STRING"), F.variant_get(v, f"$.{second}", "string"))
    return (F.when(v.isNull() | (kind == "VOID"), F.lit("")).when(kind == "STRING", F.variant_get(v, "$", "string"))
            .when(kind.startswith("OBJECT") & direct.isNotNull(), direct).otherwise(_walk(v, mode, nesting(F.to_json(v)))))


def content_to_text(v: Column) -> Column:
    """Message content as text: a text, an object with `text` or `content`, or a list of texts and of parts with `text` or
    `content`, joined by line breaks; at any depth. Other objects are shown as JSON, booleans as True and False."""
    return _as_text(v, CONTENT)


def completion_to_text(v: Column) -> Column:
    """A completion as text: a text, a message, or a list of completions joined by line breaks; at any depth."""
    return _as_text(v, COMPLETION)
