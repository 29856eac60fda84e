"""Line dedup: documents probe a sharded minimal perfect hash over the hashes of repeated lines.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased, as a
128-bit hash. Keys are counted by one partially aggregated grouping. For each shard of the keys that
several documents hold, one task builds a perfect hash and, in its order, arrays of fingerprints,
counts and owners (the smallest document). Documents send the hashes of their lines to the shards,
never the lines, and get back the keys they lose.

Hot lines: a key that makes up over a 10,000th of all repeated lines is answered where the document
is read; by that definition there are at most 10,000 such keys, so their arrays travel with the code.
All other shards then get even loads: their number follows the number of lines.

Defined results: a null or empty text is one empty line; rows with the same document id count as one
document; a null id counts as one document that comes after all others; extra columns stay, and output
columns replace input columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .perfect_hash import PerfectHash
from .registry import query, read

BLANK = b" \t\n\x0b\x0c\r"
HOT_PARTS = 10_000
SHARD_LINES = 250_000
IDS = "id bigint, high bigint, low bigint"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None if it is too short to be judged."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def line_hashes(text: str | None, min_chars: int) -> list[bytes]:
    found = (line_key(x, min_chars) for x in (text or "").encode().split(b"\n"))
    return list(dict.fromkeys(xxhash.xxh3_128_digest(k) for k in found if k is not None))


def _halves(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)


def _rows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Per batch: the id of each distinct line of each document, and the hash's two halves."""
    for batch in batches:
        ids, hashes, counts = batch.column(0), [], []
        for text in batch.column(1):
            found = line_hashes(text.as_py(), min_chars)
            hashes += found
            counts.append(len(found))
        yield ids.take(pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())), _halves(hashes)


def _table(ids: pa.Array, pair: np.ndarray, names=("id", "high", "low"), **more: np.ndarray) -> pa.RecordBatch:
    pair = np.ascontiguousarray(pair.T).view(np.int64)
    return pa.RecordBatch.from_arrays([*map(pa.array, more.values()), ids, pa.array(pair[0]), pa.array(pair[1])], [*more, *names])


class KeyTable:
    """Perfect hash, fingerprints, counts and owners of one shard. `later`: no document but those without id has the key first."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.index, self.prints, self.counts, self.owners = index, prints, counts, owners

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> KeyTable:
        index = PerfectHash.build(high)
        at = index.place(high)
        at = _apart(at)
        order = np.empty(len(at), np.int64)
        order[at] = np.arange(len(at))
        return cls(index, low[order], counts[order], owners[order])

    def loses(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
        """Which of the lines belong to another document."""
        at = self.index.place(high)
        known = (at >= 0) & (at < len(self.prints))
        for step in range(1 + len(self.index.rest)):  # equal first halves lie side by side
            near = np.clip(at + step, 0, max(len(self.prints) - 1, 0))
            hit = known & (self.prints[near] == low) if len(self.prints) else known & False
            at = np.where(hit, near, at)
            if step == 0:
                found = hit
            else:
                found |= hit
        return found & (no_id | (self.owners[np.clip(at, 0, max(len(self.owners) - 1, 0))] != ids)) if len(self.owners) else found

    def to_row(self) -> list[bytes]:
        return [self.index.to_bytes(), self.prints.tobytes(), self.counts.tobytes(), self.owners.tobytes()]

    @classmethod
    def from_row(cls, index: bytes, prints: bytes, counts: bytes, owners: bytes) -> KeyTable:
        return cls(PerfectHash.from_bytes(index), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(owners, np.int64))


def _apart(at: np.ndarray) -> np.ndarray:
    """Places of keys with equal first halves, moved to neighbouring free places."""
    order = np.argsort(at, kind="stable")
    out = at.copy()
    out[order] = np.maximum.accumulate(at[order] - np.arange(len(at))) + np.arange(len(at)) if len(at) else at[order]
    return out


def _columns(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return df["high"].to_numpy(np.int64).view(np.uint64), df["low"].to_numpy(np.int64).view(np.uint64)


def repeated_keys(lines: DataFrame) -> DataFrame:
    """Keys held by several documents: how many lines, and the smallest document."""
    return (lines.groupBy("high", "low")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("owner"), F.max("id").alias("last"), F.count("id").alias("with_id"))
            .where("owner < last or (owner is not null and with_id < n)").select("high", "low", "n", "owner"))


def lost_keys(spark: SparkSession, docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: id, text. One row per document that loses lines: id, the second halves of the keys it loses."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, pair in _rows(batches, min_chars):
            yield _table(ids, pair)

    store = scratch_dir(spark, "repeated-lines")
    repeated_keys(docs.mapInArrow(emit, IDS)).write.parquet(store)
    repeated = spark.read.parquet(store)
    size = repeated.agg(F.sum("n").alias("lines"), F.count("*").alias("keys")).first()
    lines = size["lines"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // SHARD_LINES))
    hot = repeated.where(F.col("n") > lines / HOT_PARTS).toPandas()
    hot_row = KeyTable.build(*_columns(hot), hot["n"].to_numpy(np.int64), hot["owner"].to_numpy(np.int64)).to_row()
    shard = F.pmod(F.col("low"), F.lit(shards)).cast("int")

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        table = KeyTable.build(*_columns(rows), rows["n"].to_numpy(np.int64), rows["owner"].to_numpy(np.int64))
        return pd.DataFrame([[key[0], *table.to_row()]], columns=["shard", "index", "prints", "counts", "owners"])

    tables = repeated.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, index binary, prints binary, counts binary, owners binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hot lines that are lost come out with shard -1, other lines with their shard."""
        table = KeyTable.from_row(*hot_row)
        for ids, pair in _rows(batches, min_chars):
            at = table.index.place(pair[:, 0])
            is_hot = (at >= 0) & (at < len(table.prints))
            is_hot[is_hot] = table.prints[at[is_hot]] == pair[is_hot, 1]
            no_id, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            lost = table.loses(pair[:, 0], pair[:, 1], number, no_id)
            where = np.where(lost, -1, pair[:, 1].view(np.int64) % shards).astype(np.int32)
            keep = lost | ~is_hot
            yield _table(ids.filter(pa.array(keep)), pair[keep], shard=where[keep])

    asked = docs.mapInArrow(ask, f"shard int, {IDS}")
    at_home = asked.where("shard = -1").select("id", "low")

    def probe(lines: pa.Table, table: pa.Table) -> pa.Table:
        if not (lines.num_rows and table.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        keys = KeyTable.from_row(*(table.column(c)[0].as_py() for c in ("index", "prints", "counts", "owners")))
        ids, low = lines.column("id"), lines.column("low").to_numpy()
        lost = keys.loses(lines.column("high").to_numpy().view(np.uint64), low.view(np.uint64), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy())
        return pa.table({"id": ids.filter(pa.array(lost)), "low": pa.array(low[lost])})

    at_shards = asked.where("shard >= 0").groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(probe, "id bigint, low bigint")
    return at_home.unionByName(at_shards).groupBy("id").agg(F.collect_list("low").alias("lost"))


def _strip(min_chars: int):
    @F.pandas_udf("n_lines bigint, n_dropped bigint, kept string")
    def strip(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
        out = []
        for t, gone in zip(text, lost):
            lines = (t or "").encode().split(b"\n")
            kept = lines
            if gone is not None and len(gone):
                gone = set(np.asarray(gone, np.int64).tolist())
                kept = [x for x in lines if (k := line_key(x, min_chars)) is None or int.from_bytes(xxhash.xxh3_128_digest(k)[8:], "little", signed=True) not in gone]
            out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])
    return strip


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10) -> DataFrame:
    """All rows and columns, with n_lines (before), n_dropped and kept (the text without repeated lines)."""
    slim = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    lost = lost_keys(spark, slim, min_chars).select(F.col("id").alias("_lost_id"), F.col("lost").alias("_lost"))
    joined = docs.join(lost, F.col(id_column).cast("bigint").eqNullSafe(F.col("_lost_id")), "left")
    done = joined.withColumn("_done", _strip(min_chars)(F.col(text_column), F.col("_lost"))).drop("_lost_id", "_lost")
    return done.withColumns({c: F.col(f"_done.{c}") for c in ("n_lines", "n_dropped", "kept")}).drop("_done")


@query("op7_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
shared AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op7(spark: SparkSession, root: str) -> DataFrame:
    done = drop_repeated_lines(spark, read(spark, root, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
