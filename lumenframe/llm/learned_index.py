"""Approximate nearest neighbours with learned partitions.

Fit, on at most 2 * `SAMPLE_PER_PART` distinct vectors for each of at most `MOST_PARTS` parts (those with the smallest hashes): the graph of each sampled vector's
nearest neighbours is cut into balanced parts by repeated bisection at the median of its Fiedler vector, then a
classifier with one hidden layer learns the parts of each vector's neighbours. Index: every vector goes to its most
probable part. Search: a query goes to its most probable parts until they hold `mass` of its probability, at least
`least_parts`, and is ranked there by exact inner products in double precision.

Equal vectors are one class with its `top + 1` smallest ids: no other of its rows can be among the nearest of any query,
so a vector that a third of all rows hold is one entry, searched once. Parts with many vectors, and those with many
queries, are split into blocks; every pair of blocks of a part is one group. Only the sample, counts per part and
the classifier come to the driver.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without id; rows with equal id and vector are one; equal scores go to the smaller id; fewer candidates
than asked for are all returned; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .registry import query, read

TOP = 20
PART_ROWS = 500
MOST_PARTS = 16
SAMPLE_PER_PART = 256
BLOCK = 20_000
MASS = 0.98
LEAST_PARTS = 3
HIDDEN = 96
FOUND = "h1 bigint, h2 bigint, score double, vec_id bigint"


@dataclass
class Router:
    """A small classifier of parts: one hidden layer."""
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row with other rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo:lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo:lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[lo:lo + 1024]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Parts of equal size (a power of two of them) with few graph edges between."""
    n, rng = len(near), np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    while part.max(initial=0) + 1 < parts:
        inner = part[a] == part[b]
        s, t = a[inner], b[inner]
        degree = np.bincount(s, minlength=n) + 1.0
        v = rng.standard_normal(n)
        count = np.bincount(part, minlength=part.max() + 1)
        mass = np.bincount(part, degree)
        for _ in range(60):  # the second eigenvector of each part's lazy walk
            v = 0.5 * v + 0.5 * (np.bincount(s, v[t], n) + v) / degree
            v -= (np.bincount(part, v * degree) / mass)[part]
            v /= np.sqrt(np.bincount(part, v * v, len(count)) + 1e-30)[part]
        order = np.lexsort((v, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        part = 2 * part + (rank >= (count[part] + 1) // 2)
    return part


def fit_router(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, seed: int = 7, steps: int = 400) -> Router:
    rng = np.random.default_rng(seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1.0)
    target[np.arange(len(x)), part] += 1.0 + near.shape[1] * 0.2
    target /= target.sum(axis=1, keepdims=True)
    scale = float(np.sqrt((x * x).sum(axis=1).mean()) / np.sqrt(x.shape[1])) or 1.0
    x = x / scale
    p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), min(512, len(x)))
        z1 = x[rows] @ p[0] + p[1]
        h = np.maximum(z1, 0)
        z = h @ p[2] + p[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
        d1 = d @ p[2].T * (z1 > 0)
        for i, g in enumerate((x[rows].T @ d1, d1.sum(axis=0), h.T @ d, d.sum(axis=0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return Router(*p, scale)


def fit(sample: np.ndarray, parts: int) -> Router:
    near = neighbours(sample, 16)
    return fit_router(sample, near, balanced_parts(near, parts), parts)


def vector_classes(vectors: DataFrame, top: int) -> DataFrame:
    """vectors: vec_id, v (array of double), h1, h2. Per distinct vector: h1, h2, v, its top + 1 smallest ids."""
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    return (vectors.withColumn("nth", rank).where(F.col("nth") <= top + 1)
            .groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids")))


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v, h1, h2 of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    good = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (length["n"] if length else 0))
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(11), "v")})


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def rank_block(queries: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: scores and ids of its `top` nearest in the block, nearest first."""
    many = np.array([len(x) for x in ids])
    flat, first = np.concatenate(ids), np.cumsum(many) - many
    norms = np.abs(vectors).max() * np.abs(queries).max() * vectors.shape[1]
    for lo in range(0, len(queries), 128):
        s = queries[lo:lo + 128] @ vectors.T
        k = min(top, s.shape[1])
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1] - 1e-12 * norms
        at, of = np.nonzero(s >= least[:, None])
        exact = exact_scores(queries[lo + at], vectors[of])
        for i in range(len(s)):
            own = slice(*np.searchsorted(at, [i, i + 1]))
            classes = of[own]
            n = many[classes]
            entry = np.repeat(first[classes] - np.cumsum(n) + n, n) + np.arange(n.sum())
            score, found = np.repeat(exact[own], n), flat[entry]
            order = np.lexsort((found, -score))[:top]
            yield lo + i, score[order], found[order]


def nearest(spark: SparkSession, rows: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: up to `top` nearest of each query row among all rows but those with its id."""
    vectors, asked = usable(rows, id_column, vector_column), usable(queries, id_column, vector_column)
    path = scratch_dir(spark, "vector-classes")
    vector_classes(vectors, top).write.parquet(path)
    classes = spark.read.parquet(path)
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    parts = 1
    while parts < MOST_PARTS and parts * PART_ROWS < n:
        parts *= 2
    # Bounded: 2 * SAMPLE_PER_PART vectors for each of at most MOST_PARTS parts.
    sample = _matrix(classes.orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(SAMPLE_PER_PART * parts * 2).select("v").toArrow().column("v"))
    router = spark.sparkContext.broadcast(fit(sample, parts) if parts > 1 else None)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = router.value.probabilities(_matrix(batch.column("v"))).argmax(axis=1) if router.value else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), *batch.columns], ["part", *batch.schema.names])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if router.value is None:
                row, part = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            else:
                p = router.value.probabilities(_matrix(batch.column("v")))
                order = np.argsort(-p, axis=1, kind="stable")
                sure = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
                needed = np.maximum((sure < MASS).sum(axis=1) + 1, LEAST_PARTS)
                row, place_ = np.nonzero(np.arange(p.shape[1])[None, :] < needed[:, None])
                part = order[row, place_].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *(c.take(pa.array(row)) for c in batch.columns)], ["part", *batch.schema.names])

    def stored(name: str, df: DataFrame) -> DataFrame:
        where = scratch_dir(spark, name)
        df.write.parquet(where)
        return spark.read.parquet(where)

    index = stored("vector-index", classes.mapInArrow(place, "part int, h1 bigint, h2 bigint, v array<double>, ids array<bigint>"))
    wanted = asked.select("h1", "h2").distinct().join(classes.select("h1", "h2", "v"), ["h1", "h2"])
    strangers = asked.join(classes.select("h1", "h2"), ["h1", "h2"], "left_anti").groupBy("h1", "h2").agg(F.first("v").alias("v"))
    routed = stored("routed-queries", wanted.unionByName(strangers).mapInArrow(route, "part int, h1 bigint, h2 bigint, v array<double>"))

    def block_counts(df: DataFrame) -> dict[int, int]:
        return {r["part"]: -(-r["count"] // BLOCK) for r in df.groupBy("part").count().collect()}

    held, sought = block_counts(index), block_counts(routed)
    of = lambda counts: F.element_at(F.array(*[F.lit(counts.get(p, 1)) for p in range(parts)]), F.col("part") + 1)
    block = lambda counts: F.pmod(F.xxhash64("h1", "h2"), of(counts)).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    left = index.withColumn("block", block(held)).withColumn("query_block", every(sought))
    right = routed.withColumn("query_block", block(sought)).withColumn("block", every(held))

    def rank(data: pa.Table, questions: pa.Table) -> pa.Table:
        if not (data.num_rows and questions.num_rows):
            return pa.table({k: pa.array([], t) for k, t in (("h1", pa.int64()), ("h2", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64()))})
        ids = [np.array(x.as_py(), np.int64) for x in data.column("ids")]
        row, score, found = zip(*((np.full(len(s), i), s, f) for i, s, f in rank_block(_matrix(questions.column("v")), _matrix(data.column("v")), ids, top + 1)))
        row = pa.array(np.concatenate(row))
        return pa.table({"h1": questions.column("h1").take(row), "h2": questions.column("h2").take(row), "score": np.concatenate(score), "vec_id": np.concatenate(found)})

    keys = ["part", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, FOUND)
    # A query has top + 1 rows per block it was sent to.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    best = found.groupBy("h1", "h2").agg(F.slice(ranked, 1, top + 1).alias("near"))
    mine = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best, ["h1", "h2"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    return (mine.select("query_id", F.posexplode(others).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score")))


@query("op10_learned_index")
def op10(spark: SparkSession, root: str) -> DataFrame:
    rows = read(spark, root, "embeddings").select("vec_id", "embedding")
    return nearest(spark, rows, rows.where(F.col("vec_id") % 20 == 0))
