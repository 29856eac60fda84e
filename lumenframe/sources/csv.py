"""CSV with quoted line breaks, read in blocks by many tasks.

A line of a file may begin inside a quoted field that was opened blocks earlier. Each line is a function of the state it begins
in (outside or inside of quotes) to the state it ends in. A first pass folds these functions over the lines of each block; folded
along the blocks of each file (one row per block), they give the state in which every block begins, and how many records begin
before it. The second pass then walks each block from its known state. Lines that are records by themselves never leave their
task; only lines of records that span several are grouped. The first pass also checks each block's bytes, so that each file
gets one encoding: UTF-8 with or without a mark, else Windows-1252, else Latin-1.

To the driver, and from there to all tasks, come 24 bytes for each block that begins inside quotes: 100 TB in blocks of 128 MB
have 800,000 blocks, so 20 MB if every one did.

Rules: a quote opens a quoted field at the start of a field only; inside, two quotes are one, and any other quote closes it.
Records end at a line feed outside of quotes, with or without a carriage return; empty lines are no records. An unquoted empty
field is null, a quoted one an empty text (in a table of one column an unquoted null would be an empty line). A short record is
filled with nulls, more fields than names are left out, and a text that does not fit its type is null. The first record of each
file is its header; all files must have the same. Quotes still open at the end of a file are an error. One record must fit one row.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import join_back
from ..operators.reshape import settle
from ..session import scratch_dir
from .encodings import MARK, decoded, file_kinds, fits_cp1252

#: Stands for an unquoted empty field while a record is parsed; a field with this very text reads as null.
NOTHING = "\x00null\x00"
SUMMARY = ("fh bigint, block bigint, outside_end boolean, inside_end boolean, outside_last bigint, inside_last bigint, "
           "outside_n bigint, inside_n bigint, spans boolean, utf8 boolean, cp1252 boolean")
BLOCKS = "fh bigint, block bigint, before bigint, n bigint, inside boolean, carry bigint, spans boolean, open boolean, utf8 boolean, cp1252 boolean"


def _ends(line: Column, sep: str) -> Column:
    """The state (1: inside quotes) after a line that begins outside, plus twice that of one that begins inside."""
    def walk(before_quotes: Column, start: int) -> Column:
        # 0: outside, 1: inside, 2: after a quote that may close the field or be the first of two.
        def step(state: Column, part: Column) -> Column:
            return F.when(state == 1, 2).when(F.endswith(part, F.lit(sep)) | ((state == 2) & (part == "")), 1).otherwise(0)
        return F.when(F.aggregate(before_quotes, F.lit(start), step) == 1, 1).otherwise(0)

    # A separator before the line makes its start the start of a field.
    parts = F.split(F.concat(F.lit(sep), line), '"', -1)
    both = F.transform(F.array(F.slice(parts, F.lit(1), F.size(parts) - 1)), lambda p: walk(p, 0) + 2 * walk(p, 1))
    return F.when(F.contains(line, F.lit('"')), F.get(both, F.lit(0))).otherwise(2)


def states(outside: np.ndarray, inside: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each line, from the first line's state and the ends of each line from both states."""
    flips = np.cumsum((outside == 1) & (inside == 0))
    fixed = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    after = np.where(fixed >= 0, outside[fixed] ^ ((flips - flips[fixed]) & 1), first ^ (flips & 1))
    return np.append(first, after[:-1]), after


def _stretches(*keys: np.ndarray) -> Iterator[slice]:
    """Runs of rows with equal keys."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    at = [*np.flatnonzero(change), n]
    yield from (slice(a, b) for a, b in zip(at, at[1:]))


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order (fh, block, mid, code, utf8, cp1252) to one row per block."""
    key, held = None, None

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([held], pa.schema([
            ("fh", pa.int64()), ("block", pa.int64()), ("outside_end", pa.bool_()), ("inside_end", pa.bool_()), ("outside_last", pa.int64()),
            ("inside_last", pa.int64()), ("outside_n", pa.int64()), ("inside_n", pa.int64()), ("spans", pa.bool_()), ("utf8", pa.bool_()), ("cp1252", pa.bool_())]))

    for batch in batches:
        if not batch.num_rows:
            continue
        fh, block, mid, code, utf8, cp1252 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        for part in _stretches(fh, block):
            if key != (fh[part.start], block[part.start]):
                if held:
                    yield emit()
                key = (fh[part.start], block[part.start])
                held = {"fh": key[0], "block": key[1], "outside_end": 0, "inside_end": 1, "outside_last": -1, "inside_last": -1,
                        "outside_n": 0, "inside_n": 0, "spans": False, "utf8": True, "cp1252": True}
            c = code[part]
            for name in ("outside", "inside"):
                before, after = states(c & 1, c >> 1 & 1, int(held[f"{name}_end"]))
                starts = np.flatnonzero(before == 0)
                held[f"{name}_end"] = bool(after[-1])
                held[f"{name}_n"] += int((c[starts] < 4).sum())
                if len(starts):
                    held[f"{name}_last"] = int(mid[part][starts[-1]])
            held["outside_end"], held["inside_end"] = bool(held["outside_end"]), bool(held["inside_end"])
            held["spans"] |= bool(((c & 1) == 1).any())
            held["utf8"] &= bool(utf8[part].all())
            held["cp1252"] &= bool(cp1252[part].all())
    if held:
        yield emit()


def _along_file(rows: pd.DataFrame) -> pd.DataFrame:
    """Fold the blocks of one file: how each begins, and the records that begin before it."""
    state, carry, before, out = 0, -1, 0, []
    rows = rows.sort_values("block")
    for r in rows.itertuples():
        n, last, end = (r.inside_n, r.inside_last, r.inside_end) if state else (r.outside_n, r.outside_last, r.outside_end)
        out.append((r.fh, r.block, before, n, bool(state), carry, bool(r.spans or state), False, r.utf8, r.cp1252))
        before, state = before + n, int(end)
        carry = (last if last >= 0 else carry) if state else -1
    found = pd.DataFrame(out, columns=["fh", "block", "before", "n", "inside", "carry", "spans", "open", "utf8", "cp1252"])
    found.loc[len(found) - 1, "open"] = bool(state)
    return found


def _walker(inside: dict[tuple[int, int], int]):
    """For each line: the id of the line its record begins with, whether that record spans lines, its number in the block."""
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        key, state, record, count = None, 0, -1, -1
        for fh, block, mid, code in batches:
            fh, block, mid, code = (x.to_numpy() for x in (fh, block, mid, code))
            records, spans, nth = np.empty(len(fh), np.int64), np.empty(len(fh), bool), np.empty(len(fh), np.int64)
            for part in _stretches(fh, block) if len(fh) else ():
                if key != (fh[part.start], block[part.start]):
                    key = (int(fh[part.start]), int(block[part.start]))
                    state, record, count = int(key in inside), inside.get(key, -1), -1
                c = code[part]
                before, after = states(c & 1, c >> 1 & 1, state)
                starts = before == 0
                last = np.maximum.accumulate(np.where(starts, np.arange(len(c)), -1))
                records[part] = np.where(last >= 0, mid[part][last], record)
                spans[part] = (before | after) == 1
                nth[part] = count + np.cumsum(starts & (c < 4))
                state, record, count = int(after[-1]), int(records[part][-1]), int(nth[part][-1])
            yield pd.DataFrame({"record": records, "spans": spans, "nth": nth})
    return F.pandas_udf(walk, "record bigint, spans boolean, nth bigint").asNondeterministic()


@dataclass
class CsvText:
    """The lines of CSV files, and one row per file block: how it begins, how many records begin before it, its file's encoding."""
    lines: DataFrame
    blocks: DataFrame
    extra: list[str]

    def records(self) -> DataFrame:
        """fh, file, block (where the record begins), nth (from 0, in that block), text, folder columns."""
        found = self.blocks.agg(F.max("open").alias("open"), F.max("spans").alias("spans"), F.min("utf8").alias("utf8")).first()
        spark = self.lines.sparkSession
        if found["open"]:
            bad = self.blocks.where("open").select("fh").limit(1)
            raise ValueError(f"quotes are not closed at the end of {self.lines.join(bad, 'fh').select('file').first()[0]}")
        held = self.blocks.where("inside").select("fh", "block", "carry").toArrow().to_pydict()
        inside = dict(zip(zip(held["fh"], held["block"]), held["carry"]))
        walked = self.lines.withColumn("_r", _walker(inside)("fh", "block", "mid", "code"))
        folders = [F.col(f"`{c}`") for c in self.extra]
        cut = lambda t: F.when(F.endswith(t, F.lit("\r")), F.substring(t, F.lit(1), F.char_length(t) - 1)).otherwise(t)
        out = walked.where(~F.col("_r.spans") & (F.col("code") < 4)).select("fh", "file", "block", "_r.nth", F.col("value").alias("text"), *folders)
        if found["spans"]:
            parts = F.array_sort(F.collect_list(F.struct("mid", "block", "_r.nth", "value")))
            grouped = walked.where("_r.spans").groupBy("fh", F.col("_r.record").alias("_record")).agg(
                F.first("file").alias("file"), parts.alias("_p"), *[F.first(f"`{c}`").alias(c) for c in self.extra])
            first = F.get("_p", F.lit(0))
            out = out.unionByName(grouped.select("fh", "file", first["block"].alias("block"), first["nth"].alias("nth"),
                                                 F.array_join(F.col("_p.value"), "\n").alias("text"), *folders))
        if not found["utf8"]:
            out = out.join(file_kinds(self.blocks), "fh", "left").withColumn("text", decoded(F.col("text"), F.col("kind"))).drop("kind")
        return out.withColumn("text", cut(F.col("text")))


    def places(self, across: bool = False) -> DataFrame:
        """fh, block, ahead: data records before the block's first one in its file, or (`across`) in all files in path order;
        with the number `nth` of a record in its block, it has the number ahead + nth from 1 (the first block's first is a header)."""
        first = F.when(F.col("block") == 0, 1).otherwise(0)
        if not across:
            # `before` counts the header for all blocks but the first.
            return self.blocks.select("fh", "block", F.col("before").alias("ahead"))
        spark = self.lines.sparkSession
        paths = sorted(re.sub("^file:/+", "file:/", p) for p in self.lines.inputFiles())
        files = spark.createDataFrame(list(enumerate(paths)), "rank bigint, file string").withColumn("fh", F.xxhash64("file"))
        # One row per block, as in the fold along a file.
        earlier = Window.orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
        data = F.col("n") - F.when((F.col("block") == 0) & (F.col("n") > 0), 1).otherwise(0)
        before = F.coalesce(F.sum(data).over(earlier), F.lit(0))
        return self.blocks.join(files, "fh").select("fh", "file", "block", "n", "inside", (before + 1 - first).alias("ahead"))


def _lines(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    scan = spark.read.option("lineSep", "\n").text(paths)
    value = F.col("value")
    rows = scan.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    marked = (F.col("block") == 0) & F.startswith(value, F.lit(MARK))
    rows = rows.withColumns({"fh": F.xxhash64("file"), "value": F.when(marked, F.expr("right(value, char_length(value) - 1)")).otherwise(value)})
    return rows.withColumn("code", (_ends(value, sep) + F.when(value.isin("", "\r"), 4).otherwise(0)).cast("int"))


def read_text(spark: SparkSession, paths: list[str], sep: str = ",") -> CsvText:
    """Lines of the files with the first pass over them done and stored."""
    rows = _lines(spark, paths, sep)
    path = scratch_dir(spark, "csv-blocks")
    utf8 = F.is_valid_utf8("value")
    checked = rows.select("fh", "block", "mid", "code", utf8.alias("utf8"), (utf8 | fits_cp1252(F.col("value"))).alias("cp1252"))
    checked.mapInArrow(_summarize, SUMMARY).groupBy("fh").applyInPandas(_along_file, BLOCKS).write.parquet(path)
    return CsvText(rows, spark.read.parquet(path), [c for c in rows.columns if c not in ("value", "file", "block", "mid", "fh", "code")])


def _names(header: str, sep: str) -> list[str]:
    """Column names of a header; an empty name, or one that came before, is told apart by its place."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader(io.StringIO(header, newline=""), delimiter=sep), [])):
        out.append(f"{name}_c{i}" if not name or name in out else name)
    return out


def scan_csv(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, overrides: dict[str, str] | None = None,
             sep: str = ",", file: str | None = None, number: str | None = None, across: bool = False) -> DataFrame:
    """CSV files or folders with a header as a frame. Without a schema types are inferred, which costs one more pass; `overrides`
    then replaces the types of single columns. `file` and `number` name columns for the file's address and the number of the
    record, from 1, in its file or (`across`) in all files in path order."""
    source = read_text(spark, list(paths), sep)
    records = source.records()
    is_header = (F.col("block") == 0) & (F.col("nth") == 0)
    headers = [r[0] for r in records.where(is_header).select("text").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"files differ in their headers: {sorted(headers)}")
    names = _names(headers[0], sep) if headers else []
    body = records.where(~is_header)
    how = _options(sep)
    if schema is None:
        texts = body.select("text")._jdf.__getattr__("as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        reader = spark._jsparkSession.read().option("inferSchema", True)
        for k, v in how.items():
            reader = reader.option(k, v)
        found = T.StructType.fromJson(json.loads(reader.csv(texts).schema().json())).fields
        kinds = [f.dataType for f in found] + [T.StringType()] * len(names)
        fields = [T.StructField(n, k) for n, k in zip(names, kinds)]
    else:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    changed = overrides or {}
    wanted = T.StructType([T.StructField(f.name, T.DataType.fromDDL(changed[f.name]) if f.name in changed else f.dataType) for f in fields])
    if not wanted.fields:
        return body.select(*[F.col(f"`{c}`") for c in source.extra])
    parsed = settle(body, _row=F.from_csv("text", _ddl(wanted), how))
    more = [F.col(f"`{c}`") for c in source.extra]
    if file:
        more.append(F.col("file").alias(file))
    if number:
        parsed = join_back(parsed, source.places(across).select("fh", "block", "ahead"), ["fh", "block"])
        more.append((F.col("ahead") + F.col("nth")).alias(number))
    return parsed.select(*[F.col("_row")[f.name].alias(f.name) for f in wanted.fields], *more)


def _options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "nullValue": NOTHING, "emptyValue": "", "maxCharsPerColumn": "-1", "maxColumns": "100000"}


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def pick_record(spark: SparkSession, *paths: str, n: int, sep: str = ",") -> DataFrame:
    """Data record n (from 1) of the files in path order as one row of texts; a missing record is an error.

    The block index of the first pass leads to the file, and a second one over that file alone (blocks of one file may be cut
    otherwise than among many) to the block in which the record begins. Of its lines only those from that block to the end of
    the record are walked."""
    if n <= 0:
        raise ValueError("row index must be positive")
    source = read_text(spark, list(paths), sep)

    def begins(source: CsvText, n: int):
        last = F.col("ahead") + F.col("n") - 1
        first = F.col("ahead") + F.when(F.col("block") == 0, 1).otherwise(0)
        return source.places(across=True).where((F.col("n") > 0) & (first <= n) & (last >= n)).first()

    at = begins(source, n)
    if at is None:
        raise ValueError(f"row {n} was not found")
    if len(source.lines.inputFiles()) > 1:
        ahead = source.places(across=True).where((F.col("fh") == at["fh"]) & (F.col("block") == 0)).first()["ahead"]
        n, source = n - ahead, read_text(spark, [unquote(at["file"])], sep)
        at = begins(source, n)
    index = source.places(across=True)
    nth = n - at["ahead"]
    later = index.where((F.col("fh") == at["fh"]) & (F.col("block") > at["block"]) & ~(F.col("inside") & (F.col("n") == 0))).orderBy("block").first()
    stop = later["block"] - (0 if later["inside"] else 1) if later else 2**62
    wanted = source.lines.where(F.col("block").between(at["block"], stop))
    # Lines before the block's first record get -2; lines of later blocks that its last record goes on to, -3.
    inside = {(at["fh"], b): -3 for (b,) in source.blocks.where((F.col("fh") == at["fh"]) & F.col("block").between(at["block"] + 1, stop) & F.col("inside")).select("block").collect()}
    if at["inside"]:
        inside[at["fh"], at["block"]] = -2
    walked = wanted.withColumn("_r", _walker(inside)("fh", "block", "mid", "code")).select("block", "mid", "code", "value", "_r.*")
    starts = walked.where((F.col("block") == at["block"]) & (F.col("nth") == nth) & (F.col("mid") == F.col("record")) & (F.col("code") < 4))
    begin = starts.select("record").first()[0]
    goes_on = [-3] if nth == at["n"] - 1 else []
    # One record, which fits one row.
    text = "\n".join(r["value"] for r in walked.where(F.col("record").isin(begin, *goes_on)).orderBy("block", "mid").select(
        _by_kind(source, at["fh"])).collect()).removesuffix("\r")
    header = source.records().where((F.col("block") == 0) & (F.col("nth") == 0) & (F.col("fh") == at["fh"])).select("text").first()[0]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _names(header, sep)])
    one = spark.createDataFrame([(text,)], "text string")
    return settle(one, _row=F.from_csv("text", _ddl(schema), _options(sep))).select("_row.*")


def _by_kind(source: CsvText, fh: int) -> Column:
    kind = file_kinds(source.blocks.where(F.col("fh") == fh)).select("kind").first()
    return decoded(F.col("value"), F.lit(kind[0] if kind else None)).alias("value")


def write_csv(df: DataFrame, path: str, *, gzip: bool = False) -> str:
    """Files with a header: quotes doubled, null as nothing, an empty text as two quotes, texts not trimmed."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').option("nullValue", "")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)
    return path
