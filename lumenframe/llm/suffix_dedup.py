"""Removal of repeated 200-byte strings with suffix arrays built by the difference cover modulo 3.

Which strings have to be sorted together: every string of `length` bytes holds anchors, the places whose `K` bytes
have the smallest hash; equal strings have their first anchor at the same place with the same bytes. So the windows (string
starts) of a text are dealt to their anchors, and only windows of equal anchors can be equal. Anchors found once
in the corpus end here. Runs of windows of one anchor with wholly equal texts are one class, kept once with its count;
with two or more, all its windows are repeated.

Suffix arrays: the remaining texts are dealt by anchor into buckets of bounded size. A bucket's text is sorted by
the difference-cover algorithm: triples at places that are 1 or 2 modulo 3 are sorted and named, the names sorted
by recursion until they are unique or reach `length` bytes, the other suffixes sorted by their first symbol and the
rank behind it, and both merged; then the first `length` bytes of neighbours are compared. Each piece ends in a
symbol of its own, so matches never cross pieces or documents.

Anchors with more than `MOST_CLASSES` different texts (the edge of a passage that very many documents share) do not go
to one bucket: their windows are dealt one by one by the hash of the window. Every window is judged either way.

Defined results: null and short texts keep all bytes; copies within one document count; rows with equal ids are
told apart by their texts, and equal rows are copies of each other; kept bytes may end inside a character, so they
are binary; extra columns stay, output columns are replaced.
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
from .perfect_hash import mix
from .registry import query, read

LENGTH = 200
K = 64
BUCKET_BYTES = 1_000_000
MOST_CLASSES = 3_000
CHUNK = 4_000_000


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < K:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return mix(h, 3)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    pad = -len(x) % width
    rows = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:len(x) - width + 1], left[width - 1:len(x)])


def anchor_runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: the anchor's hash, first and last window."""
    out = []
    for lo in range(0, max(len(text) - length + 1, 0), CHUNK):
        data = np.frombuffer(text, np.uint8)[lo:lo + CHUNK + length - 1]
        h = kmer_hashes(data)
        order = h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64)
        at = (window_minima(order, length - K + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        out.append((h[at[first]], first + lo, last + lo))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(2)))
    return tuple(np.concatenate(x) for x in zip(*out))


def difference_cover_order(text: np.ndarray, length: int) -> np.ndarray:
    """Places of a text of symbols in the order of their first `length` symbols or more."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text + 1, np.zeros(3, text.dtype)])
    # A dummy triple keeps the last of the places 1 mod 3 apart from what follows it.
    end = n + (n % 3 == 1)
    one, two = np.arange(1, end, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    a, b, c = s[sample], s[sample + 1], s[sample + 2]
    new = np.ones(len(sample), bool)
    if s.max() < 1 << 21:  # a triple fits one number
        triple = a << 42 | b << 21 | c
        order = np.argsort(triple)
        new[1:] = np.diff(triple[order]) != 0
    else:
        order = np.lexsort((c, b, a))
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all() and length > 3:
        order = difference_cover_order(names, -(-length // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(s[zero] << 32 | rank[zero + 1])]
    return _merged(s, rank, sampled, zero)


def _merged(s: np.ndarray, rank: np.ndarray, sampled: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Suffixes at 0 mod 3 put among the sampled ones.

    They compare with those at 1 mod 3 by one symbol and the rank behind it, with those at 2 mod 3 by two symbols
    and the rank behind them: one number each, so a place is the sum of two binary searches.
    """
    low = np.zeros(len(zero), np.int64)
    for k in (1, 2):
        others = sampled[sampled % 3 == k]
        at = np.concatenate([others, zero])
        key, behind = s[at], rank[at + k]
        if k == 2:
            narrow = max(s.max(), behind.max(initial=0)) < 1 << 21  # two symbols and a rank fit one number
            pair = key << (21 if narrow else 32) | s[at + 1]
            key = pair << 21 | behind if narrow else np.unique(pair, return_inverse=True)[1] << 32 | behind
        else:
            key = key << 32 | behind
        low += np.searchsorted(key[:len(others)], key[len(others):])
    low = np.maximum.accumulate(low) if len(low) else low  # suffixes that are equal as far as sorted may come in any order
    out = np.empty(len(sampled) + len(zero), np.int64)
    at = low + np.arange(len(zero))
    taken = np.zeros(len(out), bool)
    taken[at] = True
    out[at], out[~taken] = zero, sampled
    return out


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For each place of the joined pieces (each followed by one end place): do its `length` bytes start at another place too?"""
    sizes = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    text = joined.astype(np.int64)
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 256 + np.arange(len(pieces))
    order = difference_cover_order(text, length)
    left, right = order[:-1], order[1:]
    room = np.repeat(ends, sizes + 1) - np.arange(len(text))
    same = np.flatnonzero((room[left] >= length) & (room[right] >= length))
    wide = np.concatenate([joined, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = sum(wide[k:len(joined) + k] << np.uint64(8 * k) for k in range(8))
    for k in [*range(0, length - 7, 8), length - 8]:  # compare neighbours eight bytes at a time
        same = same[words[left[same] + k] == words[right[same] + k]]
    out = np.zeros(len(text), bool)
    out[left[same]] = True
    out[right[same]] = True
    return out


RUNS = "anchor bigint, n1 bigint, n2 bigint"


def _runs(batches: Iterator[pa.RecordBatch], length: int, with_place: bool) -> Iterator[pa.RecordBatch]:
    """batches: id, print, text. Per run of windows: the anchor, the digest of its text, and where it is."""
    for batch in batches:
        parts, digests, owner = [], [], []
        for i, text in enumerate(batch.column("text")):
            data = (text.as_py() or "").encode()
            anchor, first, last = anchor_runs(data, length)
            parts.append((anchor, first, last))
            digests += [xxhash.xxh3_128_digest(data[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
            owner.append(np.full(len(anchor), i))
        if not digests:
            continue
        anchor, first, last = (np.concatenate(x) for x in zip(*parts))
        digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = {"anchor": anchor.view(np.int64), "n1": digest[:, 0].copy(), "n2": digest[:, 1].copy()}
        arrays = {k: pa.array(v) for k, v in columns.items()}
        if with_place:
            at = pa.array(np.concatenate(owner))
            arrays |= {"id": batch.column("id").take(at), "print": batch.column("print").take(at), "first": pa.array(first), "last": pa.array(last)}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """rows: text, runs (array of struct(anchor, first, last, n)). One row per run: where it is and its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, p, text, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "print", "text", "runs"))):
                data = text.encode()
                out += [(i, p, r["anchor"], r["first"], r["n"], data[r["first"]:r["last"] + length]) for r in runs]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["id", "print", "anchor", "first", "n", "piece"])
    return rows.select("id", "print", "text", "runs").mapInArrow(run, "id bigint, print bigint, anchor bigint, first bigint, n bigint, piece binary")


SPAN = "id bigint, print bigint, first bigint, last bigint"


def _spans_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], starts.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def _sort_bucket(rows: pa.Table, length: int) -> pa.Table:
    """Repeated windows of the pieces that are there once, as runs."""
    pieces = rows.column("piece").to_pylist()
    starts = repeated_starts(pieces, length)
    base, out = 0, {k: [] for k in ("id", "print", "first", "last")}
    for i, p, first, n, piece in zip(*(rows.column(c).to_pylist() for c in ("id", "print", "first", "n")), pieces):
        if n == 1:
            a, b = _spans_of(starts[base:base + len(piece)])
            out["id"] += [i] * len(a)
            out["print"] += [p] * len(a)
            out["first"] += (a + first).tolist()
            out["last"] += (b + first).tolist()
        base += len(piece) + 1
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _single_windows(rows: DataFrame, length: int) -> DataFrame:
    """Windows of anchors with very many texts, one row each: where it is, and the digest of its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, p, first, n, piece in zip(*(batch.column(c).to_pylist() for c in ("id", "print", "first", "n", "piece"))):
                many = len(piece) - length + 1
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(piece[k:k + length]) for k in range(many)), np.int64).reshape(-1, 2)
                full = lambda v: pa.array([v] * many, pa.int64())
                yield pa.RecordBatch.from_arrays([full(i), full(p), pa.array(np.arange(first, first + many)), full(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], ["id", "print", "first", "n", "d1", "d2"])
    windows = rows.mapInArrow(run, "id bigint, print bigint, first bigint, n bigint, d1 bigint, d2 bigint")
    repeated = windows.groupBy("d1", "d2").agg(F.count("*").alias("m")).where("m > 1")
    return windows.where("n = 1").join(repeated, ["d1", "d2"]).select("id", "print", "first", F.col("first").alias("last"))


def repeated_windows(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs: id, print, text. Runs of repeated windows: id, print, first, last."""
    def stored(name: str, df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    texts = docs.select("id", "print", "text")
    counted = texts.mapInArrow(lambda b: _runs(b, length, False), RUNS).groupBy("anchor", "n1", "n2").agg(F.count("*").alias("n"))
    anchors = counted.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("classes"), F.min("n").alias("least"))
    known = stored("anchors", anchors.where("total > 1"))
    placed = texts.mapInArrow(lambda b: _runs(b, length, True), f"{RUNS}, id bigint, print bigint, first bigint, last bigint")
    runs = stored("runs", placed.join(known.select("anchor"), "anchor"))
    classes = stored("classes", runs.groupBy("anchor", "n1", "n2").agg(F.count("*").alias("n"), F.min(F.struct("id", "print", "first", "last")).alias("head")))
    whole = runs.join(classes.where("n > 1").select("anchor", "n1", "n2"), ["anchor", "n1", "n2"]).select("id", "print", "first", "last")
    # Anchors with a text that is there once and at least one other text: one run of each text goes to the sort.
    heads = classes.select("anchor", "n", "head.*").join(known.where("classes > 1 and least = 1").select("anchor", "classes"), "anchor")
    lists = heads.groupBy("id", "print").agg(F.collect_list(F.struct("anchor", "first", "last", "n")).alias("runs"))
    keyed = texts.select("id", "print", "text").join(lists.select(F.col("id").alias("_id"), F.col("print").alias("_print"), "runs"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")))
    pieces = stored("pieces", _cut(keyed, length).join(known.select("anchor", "classes"), "anchor"))
    size = pieces.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    many = F.col("classes") > MOST_CLASSES
    sorted_ = (pieces.where(~many).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
               .groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, length), SPAN))
    single = _single_windows(pieces.where(many).drop("anchor", "classes"), length)
    return whole.unionByName(sorted_).unionByName(single)


def _strip(length: int):
    def strip(text: str | None, runs) -> tuple[bytes, int]:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int64)
        if runs is not None:
            for r in runs:
                gone[r["first"]] += 1
                gone[min(r["last"] + length, len(data))] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        return np.frombuffer(data, np.uint8)[~gone].tobytes(), len(_spans_of(gone)[0])
    return strip


def remove_repeats(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns, with n_bytes, n_removed, n_spans and kept (binary)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    slim = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    spans = repeated_windows(spark, slim, length).groupBy("id", "print").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    spans = spans.select(F.col("id").alias("_id"), F.col("print").alias("_print"), "_runs")
    strip = _strip(length)

    @F.pandas_udf("kept binary, n_bytes bigint, n_spans bigint")
    def run(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        done = [strip(t, r) for t, r in zip(texts, runs)]
        return pd.DataFrame({"kept": [d[0] for d in done], "n_bytes": [len((t or "").encode()) for t in texts], "n_spans": [d[1] for d in done]})

    joined = docs.withColumn("_of", F.xxhash64(text)).join(spans, F.col(id_column).cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_print")), "left")
    done = joined.withColumn("_out", run(text, F.col("_runs")))
    return done.withColumns({"n_bytes": F.col("_out.n_bytes"), "n_removed": F.col("_out.n_bytes") - F.length("_out.kept"), "n_spans": F.col("_out.n_spans"), "kept": F.col("_out.kept")}).drop("_of", "_id", "_print", "_runs", "_out")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, root: str) -> DataFrame:
    done = remove_repeats(spark, read(spark, root, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
