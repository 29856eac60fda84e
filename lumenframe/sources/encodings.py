"""One encoding per file: UTF-8 with or without a mark, else Windows-1252, else Latin-1.

A file is cut into blocks read by many tasks, and a block may look like another encoding than its file. So a first pass checks the
bytes of all lines, added up per file; a second decodes every line of a file alike. All of it is column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "\ufeff"
#: The characters of bytes 80 to 9F in Windows-1252, in order; five bytes have none.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
UNKNOWN = "[\x81\x8d\x8f\x90\x9d]"


def fits_cp1252(text: Column) -> Column:
    """Whether each byte of a text column has a character in Windows-1252."""
    return ~F.decode(text.cast("binary"), "ISO-8859-1").rlike(UNKNOWN)


def decoded(text: Column, kind: Column) -> Column:
    """Bytes held in a text column as characters: `latin-1`, `cp1252`, or unchanged if null."""
    plain = F.decode(text.cast("binary"), "ISO-8859-1")
    return (F.when(kind == "cp1252", F.translate(plain, "".join(map(chr, range(0x80, 0xA0))), CP1252))
            .when(kind == "latin-1", plain).otherwise(text))


def decode_bytes(c: Column) -> Column:
    """Bytes as text: UTF-8 with or without a mark, else Windows-1252, else Latin-1."""
    text = c.cast("string")
    kind = F.when(~F.is_valid_utf8(text), F.when(fits_cp1252(text), "cp1252").otherwise("latin-1"))
    return F.regexp_replace(decoded(text, kind), "^\uFEFF", "")


def file_kinds(checked: DataFrame) -> DataFrame:
    """fh and kind of the files that are not UTF-8, from rows with fh, utf8 and cp1252 for lines or blocks of them."""
    files = checked.groupBy("fh").agg(F.min("utf8").alias("utf8"), F.min("cp1252").alias("cp1252"))
    return files.where(~F.col("utf8")).select("fh", F.when(F.col("cp1252"), "cp1252").otherwise("latin-1").alias("kind"))


def decode_files(lines: DataFrame, value: str = "value", file: str = "file") -> DataFrame:
    """Lines of files, each decoded by its file's encoding. Costs one more read of the lines; if all files are UTF-8, the
    lines go on as they are, without a join."""
    text = F.col(value)
    utf8 = F.is_valid_utf8(text)
    checked = lines.select(F.xxhash64(file).alias("fh"), utf8.alias("utf8"), (utf8 | fits_cp1252(text)).alias("cp1252"))
    kinds = file_kinds(checked)
    if kinds.isEmpty():
        return lines
    columns = [F.col(f"`{c}`") for c in lines.columns]
    joined = lines.withColumn("fh", F.xxhash64(file)).join(kinds, "fh", "left")
    return joined.select(*[decoded(c, F.col("kind")).alias(value) if n == value else c for n, c in zip(lines.columns, columns)])


def scan_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file and value: the lines of text files in their files' encodings, without marks. Lines end at a line feed, with or
    without a carriage return."""
    scan = spark.read.option("lineSep", "\n").text(list(paths))
    first = (F.col("_metadata.file_block_start") == 0) & F.startswith("value", F.lit(MARK))
    value = F.when(first, F.expr("right(value, char_length(value) - 1)")).otherwise(F.col("value"))
    lines = decode_files(scan.select(F.col("_metadata.file_path").alias("file"), value.alias("value")))
    # Only decoded text can be cut by characters.
    cut = F.when(F.endswith("value", F.lit("\r")), F.substring("value", F.lit(1), F.char_length("value") - 1)).otherwise(F.col("value"))
    return lines.withColumn("value", cut)


def scan_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """file and text: whole text files in their encodings, without marks. One file must fit one row."""
    found = spark.read.option("recursiveFileLookup", True).text(list(paths), wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("file"), decode_bytes(F.col("value").cast("binary")).alias("text"))
