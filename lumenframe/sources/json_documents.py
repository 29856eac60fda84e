"""JSON documents that hold a list of objects, read in blocks by many tasks.

Files are cut at closing braces, so a piece is a stretch of text before one. What a piece does depends on where it begins: inside a
string or not, and how deep. Its quotes (without escaped ones) tell the state it ends in, its brackets outside of strings how the
depth moves. A first pass adds that up per block for both states, and along the blocks of each file, so that every block's state and
depth are known. In the second pass a brace that leads back to depth one ends an entry. Most entries are one piece and never leave
their task; those of several, because of nested objects or braces in texts, are grouped.

To the driver, and from there to all tasks, come 40 bytes per block: 100 TB in blocks of 128 MB have 800,000 blocks, so 32 MB.

Rules: a document is a list, or one object, which is one row; a list's entries are rows, in no given order; a blank file has no rows; a
document that is not closed at the end of its file is an error (but a last brace of its one object may be missing). Each file has one encoding (see `encodings`). One entry must fit one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .csv import _stretches
from .encodings import MARK, decoded, file_kinds, fits_cp1252

NAMES = ["odd", "move0", "least0", "at0", "move1", "least1", "at1", "opens"]
SUMMARY = "fh bigint, block bigint, odd int, move0 bigint, least0 bigint, at0 bigint, move1 bigint, least1 bigint, at1 bigint, opens int, utf8 boolean, cp1252 boolean"
STARTS = "fh bigint, block bigint, state int, depth bigint, base int, entry bigint, fault boolean, utf8 boolean, cp1252 boolean"
FAR = 1 << 60
#: What a file begins with.
BLANK, LIST, OBJECT, OTHER = range(4)


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    scan = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(paths)
    value = F.col("value")
    rows = scan.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    rows = rows.withColumn("value", F.when((F.col("block") == 0) & F.startswith(value, F.lit(MARK)), F.expr("right(value, char_length(value) - 1)")).otherwise(value))
    # One character per byte, whatever the encoding: quotes, brackets and backslashes are the same in all.
    raw = F.decode(value.cast("binary"), "ISO-8859-1")
    plain = F.when(F.contains(raw, F.lit("\\")), F.regexp_replace(raw, r"(?s)\\.", "")).otherwise(raw)
    outside = F.when(F.contains(plain, F.lit('"')), F.regexp_replace(plain, r'"[^"]*+("|$)', "")).otherwise(plain)
    inside = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*+("|$)', ""), r'"[^"]*+("|$)', "")
    count = lambda t, marks: F.char_length(t) - F.char_length(F.translate(t, marks, ""))
    move = lambda t: count(t, "[{") - count(t, "]}")
    first = F.left(F.ltrim(raw, F.lit(" \t\r\n")), F.lit(1))
    return rows.select(
        "*", F.xxhash64("file").alias("fh"), (count(plain, '"') % 2).alias("odd"), move(outside).alias("move0"), move(inside).alias("move1"),
        F.when(first == "", BLANK).when(first == "[", LIST).when(first == "{", OBJECT).otherwise(OTHER).alias("opens"))


def _run(odd: np.ndarray, move0: np.ndarray, move1: np.ndarray, state: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """State and depth after each piece and its closing brace."""
    after = state ^ (np.cumsum(odd) & 1)
    before = np.append(state, after[:-1])
    return after, depth + np.cumsum(np.where(before == 1, move1, move0) - (after == 0))


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, None
    kinds = [("fh", pa.int64()), ("block", pa.int64()), ("odd", pa.int32()), *((n, pa.int64()) for n in NAMES[1:7]), ("opens", pa.int32()), ("utf8", pa.bool_()), ("cp1252", pa.bool_())]

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([held], pa.schema(kinds))

    for batch in batches:
        if not batch.num_rows:
            continue
        fh, block, mid, odd, move0, move1, opens, utf8, cp1252 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(9))
        for part in _stretches(fh, block):
            if key != (fh[part.start], block[part.start]):
                if held:
                    yield emit()
                key = (fh[part.start], block[part.start])
                held = {"fh": int(key[0]), "block": int(key[1]), "odd": 0, "move0": 0, "least0": FAR, "at0": -1, "move1": 0, "least1": FAR, "at1": -1,
                        "opens": int(opens[part.start]), "utf8": True, "cp1252": True}
            for s in (0, 1):
                after, depth = _run(odd[part], move0[part], move1[part], s ^ held["odd"], held[f"move{s}"])
                ends = np.flatnonzero(after == 0)
                if len(ends) and depth[ends].min() <= held[f"least{s}"]:
                    held[f"least{s}"] = int(depth[ends].min())
                    held[f"at{s}"] = int(mid[part][ends[np.flatnonzero(depth[ends] == depth[ends].min())[-1]]])
                held[f"move{s}"] = int(depth[-1])
            held["odd"] ^= int(odd[part].sum() & 1)
            held["utf8"] &= bool(utf8[part].all())
            held["cp1252"] &= bool(cp1252[part].all())
    if held:
        yield emit()


def _along_file(rows: pd.DataFrame) -> pd.DataFrame:
    """State, depth and open entry at the start of each block. The entry is the number of the piece after the brace that ended the last one."""
    rows = rows.sort_values("block")
    state, depth, entry, out = 0, 0, -1, []
    opens = int(rows["opens"].iloc[0])
    base = 1 if opens == LIST else 0
    for r in rows.itertuples():
        out.append((r.fh, r.block, state, depth, base, entry, False, r.utf8, r.cp1252))
        least, at, move = (r.least1, r.at1, r.move1) if state else (r.least0, r.at0, r.move0)
        if depth + least == base:
            entry = at + 1
        state, depth = state ^ int(r.odd), depth + move
    found = pd.DataFrame(out, columns=["fh", "block", "state", "depth", "base", "entry", "fault", "utf8", "cp1252"])
    # Past the last brace, a closed document has one piece more, at depth -1, unless it ends with the brace of its one object.
    closed = state == 0 and (depth == -1 or (depth == 0 and base == 0))
    found.loc[0, "fault"] = bool(opens == OTHER or not closed)
    return found


def _walker(starts: dict[tuple[int, int], tuple[int, int, int, int]]):
    """For each piece: its entry, whether it is all of it, and whether it is the last of its document."""
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        key, state, depth, base, entry, fresh = None, 0, 0, 0, -1, True
        for columns in batches:
            fh, block, mid, odd, move0, move1 = (c.to_numpy() for c in columns)
            entries, alone, last = np.empty(len(fh), np.int64), np.empty(len(fh), bool), np.empty(len(fh), bool)
            for part in _stretches(fh, block) if len(fh) else ():
                if key != (fh[part.start], block[part.start]):
                    key = (int(fh[part.start]), int(block[part.start]))
                    state, depth, base, entry = starts[key]
                    fresh = key[1] == 0 or (state == 0 and depth == base)
                after, deep = _run(odd[part], move0[part], move1[part], state, depth)
                done = deep < 0
                ends = ((after == 0) & (deep == base)) | done
                number = np.arange(len(ends))
                at = np.maximum.accumulate(np.append(-1, np.where(ends, number, -1)[:-1]))
                entries[part] = np.where(at >= 0, mid[part][at] + 1, entry)
                begins = np.append(fresh, ends[:-1])
                alone[part], last[part] = begins & ends, done
                if ends.any():
                    entry = int(mid[part][np.flatnonzero(ends)[-1]]) + 1
                state, depth, fresh = int(after[-1]), int(deep[-1]), bool(ends[-1])
            yield pd.DataFrame({"entry": entries, "alone": alone, "last": last})
    return F.pandas_udf(walk, "entry bigint, alone boolean, last boolean").asNondeterministic()


def entries(spark: SparkSession, *paths: str) -> DataFrame:
    """file and json: the entries of JSON documents, one or more neighbours in a row as the text of a list."""
    pieces = _pieces(spark, list(paths))
    path = scratch_dir(spark, "json-blocks")
    utf8 = F.is_valid_utf8("value")
    checked = pieces.select("fh", "block", "mid", "odd", "move0", "move1", "opens", utf8.alias("utf8"), (utf8 | fits_cp1252(F.col("value"))).alias("cp1252"))
    checked.mapInArrow(_summarize, SUMMARY).groupBy("fh").applyInPandas(_along_file, STARTS).write.parquet(path)
    blocks = spark.read.parquet(path)
    # A blank file is no fault.
    faults = blocks.where("fault").select("fh")
    bad = None if faults.isEmpty() else pieces.join(faults, "fh").where(F.col("opens") > BLANK).select("file").first()
    if bad:
        raise ValueError(f"not a closed JSON document: {bad[0]}")
    held = blocks.select("fh", "block", "state", "depth", "base", "entry").toArrow().to_pydict()
    starts = dict(zip(zip(held["fh"], held["block"]), zip(held["state"], held["depth"], held["base"], held["entry"])))
    walked = pieces.withColumn("_r", _walker(starts)("fh", "block", "mid", "odd", "move0", "move1"))
    walked = walked.select("fh", "file", "block", "mid", "value", "_r.*")
    brace = F.when(F.col("last"), "").otherwise("}")
    whole = walked.where("alone").select("fh", "file", "entry", "last", F.concat("value", brace).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "mid", F.concat("value", brace).alias("text"))))
    grouped = walked.where("NOT alone").groupBy("fh", "entry").agg(F.first("file").alias("file"), F.max("last").alias("last"), parts.alias("p"))
    both = whole.unionByName(grouped.select("fh", "file", "entry", "last", F.array_join(F.col("p.text"), "").alias("text")))
    if not blocks.agg(F.min("utf8")).first()[0]:
        both = both.join(file_kinds(blocks), "fh", "left").withColumn("text", decoded(F.col("text"), F.col("kind"))).drop("kind")
    body = both.withColumn("text", F.btrim("text", F.lit(" \t\r\n")))
    # The bracket before the first entry of a list, the comma before others.
    opened = ((F.col("entry") == -1) & F.startswith("text", F.lit("["))) | F.startswith("text", F.lit(","))
    body = body.withColumn("text", F.when(opened, F.expr("right(text, char_length(text) - 1)")).otherwise(F.col("text")))
    closed = F.when(F.col("last") & F.endswith("text", F.lit("]")), F.substring("text", F.lit(1), F.char_length("text") - 1)).otherwise(F.col("text"))
    body = body.withColumn("text", F.btrim(closed, F.lit(" \t\r\n"))).where("text <> ''")
    return body.select("file", F.concat(F.lit("["), "text", F.lit("]")).alias("json"))
