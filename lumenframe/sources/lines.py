"""Text lines with their numbers, and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.ordering import join_back
from ..operators.reshape import settle
from .encodings import decode_bytes, decode_files


def with_row_numbers(scan: DataFrame, name: str = "line", *, across: bool = False) -> DataFrame:
    """Number the rows of an unchanged file scan from 1, per file in file order, or (`across`) over all files of one writer
    in the order of their names.

    A file may be cut into blocks read by many tasks. Rows are counted per block, the
    counts are added up along the file (one row per block), and each row adds its
    place inside the block. Both reads cut the files alike.
    """
    rows = scan.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # Part numbers are padded to five digits: longer names come later.
    order = Window.orderBy(F.char_length("file"), "file", "_block") if across else Window.partitionBy("file").orderBy("_block")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return join_back(rows, offsets, ["file", "_block"]).select("file", number.alias(name), *scan.columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every text line with its file and its number in that file, in the file's encoding; blank lines count."""
    numbered = decode_files(with_row_numbers(spark.read.text(path)))
    first = F.col("line") == 1
    return numbered.withColumn("value", F.when(first, F.regexp_replace("value", "^\uFEFF", "")).otherwise(F.col("value")))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse each line; blank lines go, `json` holds the record and `error` a fault.

    A bad line keeps its row, so line numbers and counts stay whole.
    """
    text = strip(F.col(value))
    parsed = settle(lines.where(text != ""), json=F.try_parse_json(text))
    json = F.col("json")
    error = (F.when(json.isNull(), F.lit("invalid JSON"))
             .when(~F.schema_of_variant(json).startswith("OBJECT"), F.lit("must be a JSON object")))
    return parsed.withColumn("error", error)


def first_error(df: DataFrame, line: str = "line", error: str = "error") -> DataFrame:
    """The fault with the lowest line number."""
    return df.where(F.col(error).isNotNull()).orderBy(line).limit(1)


def require_clean(df: DataFrame, line: str = "line", error: str = "error") -> DataFrame:
    """Strict mode: raise on the first faulty line."""
    found = first_error(df, line, error).select(line, error).first()
    if found is not None:
        raise ValueError(f"Line {found[0]}: {found[1]}")
    return df


__all__ = ["decode_bytes", "first_error", "numbered_lines", "parse_lines", "require_clean", "with_row_numbers"]
