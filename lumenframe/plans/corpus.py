"""Cut source files into tagged snippet records.

One file is one row, and all cutting happens inside that row: no shuffle, and a
folder with very many files stays as parallel as its scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, slug_label
from ..sources.lines import with_row_numbers

# Marker forms, with the snippet name as group 1.
START = r"--8<--? \[start:([^\]]+)\]"
END = r"--8<--? \[end:([^\]]+)\]"

# Language of a file suffix.
LANGUAGES = {
    ".py": "python", ".sh": "bash", ".md": "markdown", ".json": "json",
    ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".sql": "sql",
}

# Names and name patterns of set-up and of data snippets.
SETUP_NAMES = ["setup", "context"]
SETUP_STARTS = "^(setup|prep|prepare|clean|register)"
DATA_NAME = r"^(df\d*|dataframe|dataset|players|tokens|props_[a-z0-9_]+|df_[a-z0-9_]+)\z"

BLOCK = ("array<struct<ordinal:int,name:string,marker_start_line:int,content_start_line:int,content_end_line:int,"
         "marker_end_line:int>>")


@dataclass(frozen=True)
class Tag:
    """An operation tag: searched without regard to case, shown by its label."""

    name: str
    pattern: str
    label: str


# Operation tags in search order. The first hit is the primary one.
TAGS = [
    Tag("sql", r"\bSQLContext\b|\.sql\(", "SQL"),
    Tag("join_asof", r"\bjoin_asof\b", "as-of joins"),
    Tag("join_where", r"\bjoin_where\b", "non-equi joins"),
    Tag("join", r"\bjoin\(", "joins"),
    Tag("group_by_dynamic", r"\bgroup_by_dynamic\b", "dynamic group-bys"),
    Tag("group_by_rolling", r"\bgroup_by_rolling\b|\.rolling\(", "rolling windows"),
    Tag("group_by", r"\bgroup_by\(", "group-bys"),
    Tag("aggregation", r"\.agg\(", "aggregations"),
    Tag("select", r"\.select\(", "column selection"),
    Tag("with_columns", r"\.with_columns\(", "column creation"),
    Tag("filter", r"\.filter\(", "filtering"),
    Tag("pivot", r"\bpivot\(", "pivoting"),
    Tag("unpivot", r"\bunpivot\(|\bmelt\(", "unpivoting"),
    Tag("window", r"\.over\(", "window expressions"),
    Tag("lazy", r"\.lazy\(", "lazy execution"),
    Tag("csv", r"\bread_csv\b|\bscan_csv\b|\bwrite_csv\b", "CSV I/O"),
    Tag("json", r"\bread_json\b|\bscan_ndjson\b|\bwrite_json\b|\bwrite_ndjson\b", "JSON I/O"),
    Tag("parquet", r"\bread_parquet\b|\bscan_parquet\b|\bwrite_parquet\b", "Parquet I/O"),
    Tag("excel", r"\bread_excel\b|\bwrite_excel\b", "Excel I/O"),
    Tag("database", r"\bread_database\b|\bwrite_database\b|\bread_sql\b", "database I/O"),
    Tag("cloud", r"s3://|gs://|azure", "cloud storage I/O"),
    Tag("datetime", r"\.dt\.", "datetime operations"),
    Tag("strings", r"\.str\.", "string expressions"),
    Tag("lists", r"\.list\.", "list expressions"),
    Tag("structs", r"\.struct\.", "struct expressions"),
    Tag("categoricals", r"Categorical|Enum", "categorical data"),
    Tag("visualization", r"hvplot|matplotlib|plotnine|seaborn|plotly|altair", "visualization"),
    Tag("arrow", r"\barrow\b|pycapsule", "Arrow interoperability"),
    Tag("numpy", r"\bnumpy\b|\bnp\.", "NumPy integration"),
    Tag("user_defined_function", r"\bmap_elements\b|\bapply\b|def ", "user-defined functions"),
]


def _marked(files: DataFrame) -> DataFrame:
    """Add the lines of each file and its marker lines in order."""
    text = F.col("text")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))
    numbered = F.transform(F.col("_lines"), lambda line, i: F.struct((i + 1).alias("line"), line.alias("text")))
    seen = F.filter(numbered, lambda m: m["text"].contains("--8<-") & m["text"].rlike(f"{START}|{END}"))
    marks = F.transform(seen, lambda m: F.struct(
        m["line"].alias("line"), m["text"].rlike(START).alias("opens"),
        F.when(m["text"].rlike(START), F.regexp_extract(m["text"], START, 1))
        .otherwise(F.regexp_extract(m["text"], END, 1)).alias("name")))
    return files.withColumn("_lines", lines).withColumn("_marks", marks)


def _with_fault(files: DataFrame) -> DataFrame:
    """Add the first marker fault of each file: markers must alternate start and end
    with one name, and the last block must be closed."""
    marks = F.col("_marks")

    def fault(m: Column, i: Column) -> Column:
        before = F.get(marks, i - 1)
        closing = i % 2 == 1
        said = (F.when(~closing & ~m["opens"], F.lit("unexpected end"))
                .when(closing & m["opens"], F.lit("nested start"))
                .when(closing & (m["name"] != before["name"]),
                      F.concat(F.lit("mismatched end: expected "), before["name"], F.lit(", got "), m["name"])))
        return F.struct(m["line"].alias("line"), said.alias("fault"))

    found = F.get(F.filter(F.transform(marks, fault), lambda x: x["fault"].isNotNull()), F.lit(0))
    tail = F.element_at(marks, -1)
    unclosed = F.when((F.size(marks) % 2 == 1), F.struct(
        F.size("_lines").alias("line"), F.concat(F.lit("unclosed "), tail["name"]).alias("fault")))
    return files.withColumn("_fault", F.coalesce(found, unclosed))


def violations(files: DataFrame) -> DataFrame:
    """First marker fault per file, with its line."""
    return (_with_fault(_marked(files)).where("_fault is not null")
            .select("path", F.col("_fault.line").cast("bigint").alias("line"), F.col("_fault.fault").alias("fault")))


def segments(files: DataFrame, *, strict: bool = False) -> DataFrame:
    """Blocks between markers; a file without markers is one block named `file`.

    Files with a fault give no blocks, or an error in strict mode.
    """
    clean = _with_fault(_marked(files))
    fault = F.col("_fault")
    none = F.array().cast(BLOCK)
    if strict:
        none = F.raise_error(F.concat(fault["fault"], F.lit(" in "), F.col("path"), F.lit(" at line "),
                                      fault["line"].cast("string"))).cast(BLOCK)
    marks = F.col("_marks")

    def block(i: Column) -> Column:
        a, b = F.get(marks, i * 2), F.get(marks, i * 2 + 1)
        return F.struct((i + 1).alias("ordinal"), a["name"].alias("name"), a["line"].alias("marker_start_line"),
                        (a["line"] + 1).alias("content_start_line"), (b["line"] - 1).alias("content_end_line"),
                        b["line"].alias("marker_end_line"))

    whole = F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("file").alias("name"), F.lit(0).alias("marker_start_line"),
                             F.lit(1).alias("content_start_line"), F.size("_lines").alias("content_end_line"),
                             F.lit(0).alias("marker_end_line")))
    count = F.floor(F.size(marks) / 2).cast("int")
    # Faulty files list no blocks: a filter would find the markers a second time.
    blocks = F.when(fault.isNotNull(), none).when(count == 0, whole.cast(BLOCK)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), block).cast(BLOCK))
    # The list of blocks is exploded first, so lines are split once per file.
    one = clean.select("path", "text", "_lines", F.explode(blocks).alias("b"))
    size = F.col("b.content_end_line") - F.col("b.content_start_line") + 1
    body = F.slice("_lines", F.col("b.content_start_line"), F.greatest(size, F.lit(0)))
    code = (F.when(F.col("b.marker_start_line") == 0, F.col("text"))
            .when(size <= 0, F.lit("")).otherwise(F.concat(F.array_join(body, "\n"), F.lit("\n"))))
    return one.select("path", "b.*", code.alias("code"))


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part, with its dot; none gives ''."""
    return F.lower(F.regexp_extract(path, r"[^/]+?(\.[^./]+)\z", 1))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    ext = suffix(path)
    return F.coalesce(names[ext], F.nullif(F.ltrim(ext, F.lit(".")), F.lit("")), F.lit("text"))


def path_parts(path: Column) -> Column:
    """category, subcategories and file stem of a relative path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]+\z", "")
    return F.struct(
        F.when(n > 1, F.element_at(parts, 1)).otherwise(F.lit("root")).alias("category"),
        F.when(n > 2, F.slice(parts, F.lit(2), n - 2)).otherwise(F.array().cast("array<string>")).alias("subcategories"),
        stem.alias("file_stem"))


def role(name: Column) -> Column:
    low = F.lower(name)
    return (F.when(low == "file", "file").when(low.isin(*SETUP_NAMES), "setup").when(low.rlike(SETUP_STARTS), "setup")
            .when(low.rlike(DATA_NAME), "data").otherwise("example"))


def operations(code: Column, tags: list[Tag] = TAGS) -> Column:
    """Names of all tags of which the pattern occurs, in tag order."""
    hits = F.array(*[F.when(code.rlike(f"(?iUm){t.pattern}"), F.lit(t.name)) for t in tags])
    return F.array_compact(hits)


def tag_label(name: Column, tags: list[Tag] = TAGS) -> Column:
    labels = F.create_map(*[F.lit(x) for t in tags for x in (t.name, t.label)])
    return F.coalesce(labels[name], F.translate(name, "_", " "))


# The sentences on what a snippet is for, by role and by whether an operation was found ({label}).
SENTENCES = {
    ("setup", False): "Setup code for the {context} snippets.",
    ("data", True): "Builds example input data for {label} in {context}.",
    ("data", False): "Builds example input data for the {context} snippets.",
    ("file", False): "Full source file from {context} when no explicit snippet markers are available.",
    ("example", True): "Demonstrates {label} in {context}.",
    ("example", False): "Example snippet from {context}.",
}


def purpose(role_: Column, context: Column, primary: Column, tags: list[Tag] = TAGS) -> Column:
    """One sentence on what a snippet is for: that of its role and operation, else that of its role, else an example's."""
    held = {"context": context, "label": tag_label(primary, tags)}

    def sentence(pattern: str) -> Column:
        return F.concat(*[held[part] if i % 2 else F.lit(part) for i, part in enumerate(re.split(r"\{(\w+)\}", pattern))])

    chosen = F
    for (name, operated), pattern in SENTENCES.items():
        if name != "example":
            chosen = chosen.when((role_ == name) & primary.isNotNull() if operated else role_ == name, sentence(pattern))
    return chosen.when(primary.isNotNull(), sentence(SENTENCES["example", True])).otherwise(sentence(SENTENCES["example", False]))


def title(topic_label: Column, snippet_label: Column) -> Column:
    glue = F.when(F.lower(snippet_label).isin("setup", "file"), F.lit(" ")).otherwise(F.lit(": "))
    return F.concat(topic_label, glue, snippet_label)


def context_label(category_label: Column, sub_labels: Column, topic_label: Column) -> Column:
    return F.array_join(F.concat(F.array(category_label), sub_labels, F.array(topic_label)), " / ")


def ordered_unique(values: Column) -> Column:
    """Values without blanks and repeats, in first order."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def line_count(code: Column) -> Column:
    """Lines of a text; a final line break starts no further line."""
    return F.when(code == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(code, r"\r?\n\z", ""), r"\r?\n")))


def stats(code: Column, library: str, alias: str) -> Column:
    """Counts and flags of a snippet; `library` and `alias` name the module looked for."""
    return F.struct(
        line_count(code).alias("line_count"), F.char_length(code).alias("char_count"),
        code.contains("import ").alias("has_import"), code.contains("print(").alias("has_print"),
        (code.contains(f"{alias}.") | code.contains(f"import {library}")).alias("has_library"),
        is_blank(code).alias("is_empty"))


def records(blocks: DataFrame, root: str, library: str, alias: str, tags: list[Tag] = TAGS) -> DataFrame:
    """Nested snippet records. The id may repeat; path and ordinal tell records apart."""
    parts = path_parts(F.col("path"))
    base = blocks.select(
        "*", parts["category"].alias("category"), parts["subcategories"].alias("subcategories"),
        parts["file_stem"].alias("file_stem"), language(F.col("path")).alias("language"),
        role(F.col("name")).alias("role"), operations(F.col("code"), tags).alias("operations"))
    labelled = base.withColumns({
        "category_label": slug_label(F.col("category")),
        "sub_labels": F.transform("subcategories", slug_label),
        "topic_label": slug_label(F.col("file_stem")),
        "snippet_label": slug_label(F.col("name")),
    })
    c = F.col
    label = context_label(c("category_label"), c("sub_labels"), c("topic_label"))
    primary = F.get(c("operations"), F.lit(0))
    tag_list = ordered_unique(F.concat(
        F.array("category"), c("subcategories"), F.array("file_stem", "name", "role", "language"), c("operations")))
    return labelled.select(
        F.concat(c("path"), F.lit("#"), c("name")).alias("id"), "language",
        F.struct(
            F.lit(root).alias("root"), c("path"), c("file_stem"), c("category"), c("subcategories"),
            c("name").alias("snippet_name"), c("ordinal").alias("snippet_ordinal"), c("marker_start_line"),
            c("content_start_line"), c("content_end_line"), c("marker_end_line"),
            F.sha1(F.encode(c("code"), "UTF-8")).alias("sha1")).alias("source"),
        F.struct(
            F.struct(c("category_label"), c("sub_labels").alias("subcategory_labels"), c("file_stem").alias("topic"),
                     c("topic_label"), label.alias("context_label")).alias("path"),
            F.struct(c("snippet_label").alias("label"), c("role"), title(c("topic_label"), c("snippet_label")).alias("title")).alias("snippet"),
            F.struct(c("operations"), primary.alias("primary_operation"),
                     purpose(c("role"), label, primary, tags).alias("purpose"), tag_list.alias("tags")).alias("inferred"),
        ).alias("metadata"),
        stats(c("code"), library, alias).alias("stats"), "code")


IN_ORDER = ("source.path", "source.content_start_line", "source.snippet_ordinal")


def write_corpus(recs: DataFrame, folder: str, source_root: str) -> str:
    """Records as JSON lines in total order by path, line and ordinal, and a head record with the totals.

    One shuffle by ranges of the three narrow keys puts the records in order across files of the sink; each is sorted by
    itself. The head is counted on what was written, of which only path and category are read.
    """
    spark = recs.sparkSession
    recs.repartitionByRange(*IN_ORDER).sortWithinPartitions(*IN_ORDER).write.option("ignoreNullFields", False).json(f"{folder}/snippets")
    written = spark.read.schema("source struct<path:string,category:string>").json(f"{folder}/snippets")
    per = written.groupBy("source.category", "source.path").agg(F.count(F.lit(1)).alias("n")).groupBy("category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("n"))
    # One row per category of the source tree.
    totals = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))
    head = per.agg(F.lit(1).alias("schema_version"), F.lit(source_root).alias("source_root"), F.coalesce(F.sum("files"), F.lit(0)).alias("file_count"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("snippet_count"), totals.alias("categories"))
    head.write.json(f"{folder}/head")
    return folder


def read_corpus(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The records of a written corpus with `place`, their number in its order: counts per file of the sink are the offsets."""
    return with_row_numbers(spark.read.schema(schema).json(f"{folder}/snippets"), "place", across=True).drop("file")


def read_head(spark: SparkSession, folder: str) -> DataFrame:
    """The head record: totals, and snippets per category."""
    return spark.read.schema("schema_version int, source_root string, file_count bigint, snippet_count bigint, categories map<string,bigint>").json(f"{folder}/head")


def summary(recs: DataFrame) -> DataFrame:
    """Snippets and files per category, and of all (category null)."""
    per = recs.groupBy("source.category", "source.path").agg(F.count(F.lit(1)).alias("_n"))
    return per.rollup("category").agg(F.count(F.lit(1)).alias("files"), F.sum("_n").alias("snippets"))
