"""Fill placeholders of code templates from table rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, slug, strip
from ..operators.reshape import settle

# Column names tried in order for each kind of placeholder.
PRIORITIES = {
    "entity_column": ["Product Name", "Customer Name", "Category", "Sub-Category", "City"],
    "metric_column": ["Sales", "Profit", "Quantity", "Discount", "Postal Code"],
    "date_column": ["Order Date", "Ship Date"],
    "id_column": ["Order ID", "Customer ID", "Product ID", "Row ID"],
}

# The task mark, and the request message with its parts in braces.
TASK = "contextualize_snippet"
MESSAGE = """Contextualize the snippet with the provided CSV sample.

Rules:
- Keep the snippet language and overall intent.
- Replace generic placeholders with concrete dataset values.
- Prefer exact CSV column names when referencing fields.
- Prefer the provided dataset_var_name and row_var_name for new variable names.
- Do not add explanations before or after the snippet.

Original snippet:
{snippet}

Rule-based draft:
{draft}

CSV row context:
{row}

Column aliases:
{aliases}

Representative columns:
{chosen}

Return only the final contextualized snippet."""

TOKENS = "map<string,struct<place:int,text:string>>"


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, null as ''."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def row_map(df: DataFrame) -> Column:
    """The row as a map from column name to text."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]),
                             F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]))


def column_kind(name: Column, value: Column) -> Column:
    return (F.when(F.lower(name).endswith("id"), "identifier").when(value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), "date")
            .when(value.rlike(r"^-?\d+(?:\.\d+)?$"), "numeric").otherwise("text"))


def profile(df: DataFrame) -> Column:
    """Column name, alias and kind of each value of a row; aliases are constants."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return F.array(*[F.struct(F.lit(c).alias("column"), slug(F.lit(c)).alias("alias"),
                              column_kind(F.lit(c), text(c)).alias("kind")) for c in df.columns])


def representatives(columns: list[str], priorities: dict[str, list[str]] = PRIORITIES) -> dict[str, str]:
    """The column that stands for each placeholder, chosen from the header alone.

    Without an entity the first column serves; without a metric the choice needs the
    row, see `representative_columns`.
    """
    chosen = {label: next((c for c in wanted if c in columns), None) for label, wanted in priorities.items()}
    chosen["entity_column"] = chosen.get("entity_column") or columns[0]
    return {k: v for k, v in chosen.items() if v}


def representative_columns(row: Column, columns: list[str], priorities: dict[str, list[str]] = PRIORITIES) -> dict[str, Column]:
    """Placeholder label to column name, as columns; null where there is none."""
    fixed = representatives(columns, priorities)
    out = {label: F.lit(name) for label, name in fixed.items()}
    if "metric_column" not in fixed:
        numbers = F.filter(F.map_entries(row), lambda e: column_kind(e["key"], e["value"]) == "numeric")
        out["metric_column"] = F.get(numbers, F.lit(0))["key"]
    return out


def tokens_of(var: str, columns: dict[str, str], aliases: dict[str, str], chosen: dict[str, str]) -> dict[str, tuple[int, str]]:
    """Tokens with their places in the order of replacement and their texts; those with an empty text are left out. A token named
    twice keeps its first place and takes its last text."""
    named = {"dataset": var, "row": f"{var}_row", **{label: chosen.get(label, "") for label in ("entity_column", "metric_column", "date_column", "id_column")}}
    for name, value in columns.items():
        for shown in (name, aliases[name]):
            named[f"column:{shown}"], named[f"value:{shown}"] = name, value
    made = {form % token: text for token, text in named.items() for form in ("{%s}", "<%s>")}
    return {token: (place, text) for place, (token, text) in enumerate(made.items()) if text}


def token_map(pairs: list[tuple[str, Column]]) -> Column:
    """Tokens with texts that differ from row to row, in the order of replacement."""
    listed = F.array(*[F.struct(F.lit(token), F.struct(F.lit(i).alias("place"), to.alias("text"))) for i, (token, to) in enumerate(pairs)])
    return F.map_from_entries(F.filter(listed, lambda e: F.coalesce(e["col2"]["text"] != "", F.lit(False)))).cast(TOKENS)


def replace_tokens(text: Column, tokens: Column) -> Column:
    """Replace tokens in the order of their places: a token sees the output of those before it, and is not looked for again.

    tokens: `TOKENS`, each beginning with `{` or `<`. A scan finds all that looks like a token and looks it up; the first one in
    order is replaced, and the next scan goes on from its place. So there are as many scans as different tokens in the text, and
    the plan has the same size for any number of tokens. Tokens with brackets inside are looked for one by one.
    """
    regular = r"^(\{[^{}]+\}|<[^<>]+>)$"
    odd = F.filter(F.map_keys(tokens), lambda t: ~t.rlike(regular))
    openers = lambda t: F.char_length(t) - F.char_length(F.translate(t, "{<", ""))
    made = F.exists(F.map_values(tokens), lambda v: openers(v["text"]) > 0)
    # Without brackets in the texts, each further token needs an opening bracket of the snippet.
    most = F.when(made, F.size(tokens)).otherwise(F.least(F.size(tokens), openers(text)))

    def step(acc: Column, _: Column) -> Column:
        seen = F.array_union(F.regexp_extract_all(acc["text"], F.lit(r"\{[^{}]+\}"), F.lit(0)), F.regexp_extract_all(acc["text"], F.lit("<[^<>]+>"), F.lit(0)))
        seen = F.concat(seen, F.filter(odd, lambda t: F.contains(acc["text"], t)))
        found = F.transform(F.filter(seen, lambda t: F.map_contains_key(tokens, t)),
                            lambda t: F.struct(F.element_at(tokens, t)["place"].alias("place"), t.alias("token"), F.element_at(tokens, t)["text"].alias("to")))
        first = F.array_min(F.filter(found, lambda x: x["place"] > acc["place"]))
        state = lambda text, place: F.struct(text.alias("text"), place.alias("place"))
        # Past the last token the place is -2, and nothing is looked for any more.
        nxt = F.get(F.transform(F.array(first), lambda x: F.when(x.isNull(), state(acc["text"], F.lit(-2))).otherwise(
            state(F.replace(acc["text"], x["token"], x["to"]), x["place"]))), F.lit(0))
        return F.when(acc["place"] == -2, acc).otherwise(nxt)

    start = F.struct(text.alias("text"), F.lit(-1).alias("place"))
    replaced = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["text"])
    return F.when(most > 0, replaced).otherwise(text)


def replace_words(text: Column, words: dict[str, str | Column]) -> Column:
    """Replace whole words, with Unicode word borders."""
    for word, to in words.items():
        text = F.regexp_replace(text, F.lit(rf"(?U)\b{word}\b"), F.lit(to) if isinstance(to, str) else to)
    return text


def json_text(c: Column) -> Column:
    """A text as a JSON string; the JSON writer is called only where it must escape."""
    listed = F.to_json(F.array(c))
    written = F.substring(listed, F.lit(2), F.char_length(listed) - 2)
    return F.when(c.rlike(r'[\x00-\x1F"\\]'), written).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def message(snippet: Column, draft: Column, row: Column, aliases: Column, chosen: Column) -> Column:
    """Request text of a snippet; the last three are JSON objects as text."""
    held = {"snippet": snippet, "draft": draft, "row": row, "aliases": aliases, "chosen": chosen}
    parts = re.split(r"\{(\w+)\}", MESSAGE)
    return F.concat(*[held[part] if i % 2 else F.lit(part) for i, part in enumerate(parts)])


def row_context(spark: SparkSession, columns: dict[str, str], dataset: str, index: int, priorities: dict[str, list[str]] = PRIORITIES) -> DataFrame:
    """All that depends on the picked row alone, as one row: tokens, the JSON texts of the message, and the context record.

    Names and values of one row are plain data here, so no plan grows with the number of columns."""
    cells = spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate([(dataset, ""), *columns.items()])], "i int, name string, value string")
    found = sorted(tuple(r) for r in cells.select("i", slug(F.col("name")), column_kind(F.col("name"), F.col("value"))).collect())
    var, aliases = found[0][1], {n: a for n, (_, a, _) in zip(columns, found[1:])}
    kinds = {n: k for n, (_, _, k) in zip(columns, found[1:])}
    # Columns named by the priorities come first; those that stand in for missing ones follow.
    fixed = representatives(list(columns), priorities)
    chosen = {label: n for label, n in fixed.items() if n in priorities.get(label, ())} | fixed
    if "metric_column" not in chosen and "numeric" in kinds.values():
        chosen["metric_column"] = next(n for n, k in kinds.items() if k == "numeric")
    tokens = {t: {"place": p, "text": text} for t, (p, text) in tokens_of(var, columns, aliases, chosen).items()}
    record = {"__task": TASK, "dataset_name": dataset, "dataset_var_name": var, "row_var_name": f"{var}_row", "row_index": index, "row": columns,
              "column_aliases": aliases, "column_kinds": kinds, "representative_columns": chosen, "representative_values": {label: columns[n] for label, n in chosen.items()}}
    block = lambda entries: json.dumps(entries, ensure_ascii=False, indent=2)
    texts = "map<string,string>"
    schema = (f"_tokens {TOKENS}, _row_json string, _aliases string, _chosen string, tables struct<__task:string,dataset_name:string,dataset_var_name:string,"
              f"row_var_name:string,row_index:bigint,row:{texts},column_aliases:{texts},column_kinds:{texts},representative_columns:{texts},representative_values:{texts}>")
    return spark.createDataFrame([(tokens, block(columns), block(aliases), block(chosen), record)], schema)


def contextualize(snippets: DataFrame, table: DataFrame, dataset: str, index: int, *, source: str | None = None,
                  priorities: dict[str, list[str]] = PRIORITIES, strict: bool = False) -> DataFrame:
    """Every snippet as a request row for one picked row of a table (see `sources.csv.pick_record`).

    The snippets may be a table of any size: the one row is broadcast to it. All fields
    of a snippet stay. A blank snippet keeps its row with an `error`; with `strict` it
    is raised. `index` is the number of the row.
    """
    picked = as_text(table).take(2)
    if len(picked) != 1:
        raise ValueError("one row has to be picked")
    spark = table.sparkSession
    context = row_context(spark, dict(zip(table.columns, picked[0])), dataset, index, priorities)
    fault = F.when(F.coalesce(is_blank(F.col("snippet")), F.lit(True)), F.lit("empty snippet"))
    if strict:
        fault = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("empty snippet: "), F.col("id").cast("string"))))
    both = snippets.withColumns({"error": fault, "snippet": strip(F.col("snippet"))}).crossJoin(F.broadcast(context))
    var = F.col("tables.dataset_var_name")
    draft = replace_words(replace_tokens(F.col("snippet"), F.col("_tokens")), {"df": var, "row": F.col("tables.row_var_name")})
    drafted = both.withColumn("rule_based_draft", F.when(F.col("error").isNull(), draft))
    text = message(F.col("snippet"), F.col("rule_based_draft"), F.col("_row_json"), F.col("_aliases"), F.col("_chosen"))
    made = {"row_index": F.col("tables.row_index"), "csv_file": F.lit(source or dataset), "message": F.when(F.col("error").isNull(), text)}
    return drafted.withColumns(made).drop("_tokens", "_row_json", "_aliases", "_chosen")


def snippet_items(records: DataFrame, key: str = "line", json: str = "json") -> DataFrame:
    """One row per snippet of JSON inputs: a list, an object with a list `snippets`, or
    one object or text. Columns: the key, the position and the item."""
    return records.select(key, F.posexplode(_items(F.col(json))).alias("position", "item")).withColumn("position", F.col("position") + 1)


def _items(v: Column) -> Column:
    inner = F.try_variant_get(v, "$.snippets", "variant")
    kind, inner_kind = F.schema_of_variant(v), F.schema_of_variant(inner)
    return (F.when(kind.startswith("OBJECT") & inner_kind.startswith("ARRAY"), F.variant_get(v, "$.snippets", "array<variant>"))
            .when(kind.startswith("ARRAY"), F.variant_get(v, "$", "array<variant>")).otherwise(F.array(v)))


def normalized_snippets(items: DataFrame, number: Column, item: str = "item") -> DataFrame:
    """id, snippet and error of each item: a text, or an object with `snippet` or, where
    that is blank, `code`. The number makes the id of items without one."""
    v = F.col(item)
    kind = F.schema_of_variant(v)

    def text_field(name: str) -> Column:
        field = F.variant_get(v, f"$.{name}", "variant")
        text = F.when(F.schema_of_variant(field) == "STRING", F.variant_get(v, f"$.{name}", "string"))
        return F.when(~is_blank(text), text)

    fallback = F.concat(F.lit("snippet-"), number.cast("string"))
    is_text, is_object = kind == "STRING", kind.startswith("OBJECT")
    snippet = F.when(is_text, F.variant_get(v, "$", "string")).when(is_object, F.coalesce(text_field("snippet"), text_field("code")))
    given = F.when(is_object, F.variant_get(v, "$.id", "string"))
    error = (F.when(~(is_text | is_object), F.lit("entries must be JSON objects or strings"))
             .when(snippet.isNull(), F.lit("entries must include a non-empty 'snippet' or 'code' field")))
    return items.select(*[c for c in items.columns if c != item], F.coalesce(given, fallback).alias("id"),
                        snippet.alias("snippet"), error.alias("error"))


def input_kind(path: Column) -> Column:
    """How a snippet input is read: `jsonl` and `json` by the suffix, all else as plain `text`."""
    return F.when(F.lower(path).endswith(".jsonl"), "jsonl").when(F.lower(path).endswith(".json"), "json").otherwise("text")


def load_snippets(files: DataFrame, kind: Column | None = None) -> DataFrame:
    """files: path, text (see `sources.files.scan_sources`; a text given inline is a file without a path). One row per snippet with
    the file's columns but its text, position, id, snippet and error; a file that holds none has one row at position 0 with its fault.

    A text file is one snippet, named by its file's stem. A JSON file is a list, an object with a list `snippets`, or one entry. In a
    file of JSON lines, blank lines count for the numbers but hold no entry.
    """
    kind = input_kind(F.coalesce("path", F.lit(""))) if kind is None else kind
    entry = "array<struct<position:int,item:variant,fault:string>>"
    none = F.lit(None)

    def one(position, item, fault) -> Column:
        return F.struct(position.cast("int").alias("position"), item.cast("variant").alias("item"), fault.cast("string").alias("fault"))

    def or_fault(entries: Column, fault: str) -> Column:
        return F.when(F.size(entries) > 0, entries).otherwise(F.array(one(F.lit(0), none, F.lit(fault))).cast(entry))

    text = strip(F.coalesce("text", F.lit("")))
    plain = F.when(text == "", F.array(one(F.lit(0), none, F.lit("empty file")))).otherwise(F.array(one(F.lit(1), text, none))).cast(entry)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x, i: F.struct((i + 1).alias("n"), strip(x).alias("text")))
    parsed = lambda x: F.try_parse_json(x["text"])
    listed = F.transform(F.filter(lines, lambda x: x["text"] != ""), lambda x: one(x["n"], parsed(x), F.when(parsed(x).isNull(), "invalid JSON"))).cast(entry)
    found = settle(files.withColumn("_kind", kind), _json=F.when(F.col("_kind") == "json", F.try_parse_json(text)))
    whole = F.transform(_items(F.col("_json")), lambda x, i: one(i + 1, x, none)).cast(entry)
    entries = (F.when(F.col("_kind") == "text", plain).when(F.col("_kind") == "jsonl", or_fault(listed, "no snippets found"))
               .when(F.col("_json").isNull(), F.array(one(F.lit(0), none, F.lit("invalid JSON"))).cast(entry)).otherwise(or_fault(whole, "no snippets found")))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    others = [F.col(f"`{c}`") for c in files.columns if c != "text"]
    rows = found.select(*others, F.when((F.col("_kind") == "text") & (stem != ""), stem).alias("_stem"), F.inline(entries))
    made = normalized_snippets(rows, F.col("position"))
    bad = F.coalesce("fault", "error")
    return made.select(*others, "position", F.when(F.col("position") > 0, F.coalesce("_stem", "id")).alias("id"),
                       F.when(bad.isNull(), F.col("snippet")).alias("snippet"), bad.alias("error"))
