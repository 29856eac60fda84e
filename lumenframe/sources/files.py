"""File scans and sinks over Spark's readers and writers (CSV: see `csv`)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv import scan_csv, write_csv
from .encodings import scan_lines, scan_texts
from .json_documents import entries


def scan_parquet(spark: SparkSession, *paths: str, glob: str | None = None, base: str | None = None) -> DataFrame:
    """Parquet files or folders. `key=value` folders below a folder, or below `base`,
    become columns; `glob` leaves foreign files out without turning that off."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if base:
        reader = reader.option("basePath", base)
    return reader.parquet(*paths)


def scan_leaves(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """Leaf folders as one frame without their partition columns."""
    out = None
    for folder in folders:
        part = spark.read.parquet(folder)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no folders given")
    return out


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, lines: bool = True,
              any_encoding: bool = False) -> DataFrame:
    """JSON lines, or documents that hold a list of objects (see `json_documents`). With `any_encoding` the encoding of each
    file of lines is found first; documents always have theirs found."""
    if lines and not any_encoding:
        return (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    texts = scan_lines(spark, path).select("value") if lines else entries(spark, path).select("json")
    reader = spark._jsparkSession.read()
    if schema is not None:
        reader = reader.schema(schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">"))
    typed = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader.json(typed), spark)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> str:
    """One object per line, nulls and Unicode kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def file_list(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(plain_path(F.col("path")).alias("path"), "length").orderBy("path")


def scan_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Choose the reader by the suffix of the path."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in ("json", "jsonl"):
        return scan_json(spark, path, schema)
    if suffix == "csv":
        return scan_csv(spark, path, schema=schema)
    if suffix == "parquet":
        return scan_parquet(spark, path)
    raise ValueError(f"no reader for {path}")


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder as one row: path relative to the folder, and text in whatever encoding the file has."""
    return scan_texts(spark, root).select(relative_path(spark, root, F.col("file")).alias("path"), "text")


def plain_path(path: Column) -> Column:
    """A file's address without percent encoding (a plus sign stands for itself)."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def relative_path(spark: SparkSession, root: str, path: Column) -> Column:
    """The part of a file's address below a folder; an address outside it is an error."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(root)
    full = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    shown = plain_path(path)
    start = F.regexp_replace(F.lit(full), "^file:/+", "file:/")
    below = F.substring(shown, F.char_length(start) + 1, F.lit(2_147_483_647))
    return F.when(F.startswith(shown, start), below).otherwise(F.raise_error(F.concat(F.lit("not below the folder: "), shown)))
