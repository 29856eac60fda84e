"""Hard-negative mining with segment summary filtering.

Index: every vector, as whole numbers, with the mean and the deviation (the length of what is left when the mean is
taken off) of each of its 1, 2, 4 and 8 segments. For a segment of m components the inner product of two vectors lies
within m * mean * mean plus or minus deviation * deviation; sums over segments bound a score from both sides.

Search: rows and anchors are dealt to blocks, and each pair of blocks is one group. There, all pairs start at one
segment and are refined level by level: a pair goes once its bounds leave the anchor's windows of scores, or once
enough rows certainly inside all windows are certainly better. What is left is scored exactly. Positives come first;
their scores give the windows of the second search, for negatives.

Blocks hold a bounded number of components, so neither a label nor a vector that a third of all rows share weighs on
one task; each block gives at most `top` rows per window, and these are cut again by the window over all blocks.
The work grows with anchors times rows, as the task is stated; the filter saves exact scores, not pairs of blocks.

Defined results: rows whose id, label or vector is null, or with any null or non-finite component, take no part; rows
equal in id, label and vector count once; rows with the anchor's id are never its positives; vectors of different
lengths have no score; empty vectors score 0 with each other; equal scores go to the smaller id; an anchor without
positives, or a positive whose window holds no row, gives no rows; an empty table gives no rows; extra columns are not
looked at. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .registry import query, read

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
LEVELS = (1, 2, 4, 8)
BLOCK_NUMBERS = 1 << 21
LEAST_ROWS = 1000
CHUNK_PAIRS = 1 << 21
SPARSE = 0.1
INDEX = "vec_id bigint, label bigint, q array<bigint>, h bigint, means array<double>, deviations array<double>"


def whole_numbers(rows: DataFrame, id_column: str, label_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (floor of scale times each component), h of the rows that take part, each once."""
    rows = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("bigint").alias("label"),
                       F.col(vector_column).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & good)
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("q"))
    return rows.dropDuplicates(["vec_id", "label", "q"]).withColumn("h", F.xxhash64("label", "q"))


def levels_of(size: int) -> list[np.ndarray]:
    """First components of the segments of each level that is coarser than the vector itself."""
    return [np.arange(s) * size // s for s in LEVELS if s < size]


def segment_lengths(starts: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(starts, size)).astype(float)


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all levels' segments, side by side."""
    means, deviations = [], []
    for starts in levels_of(x.shape[1]):
        m = segment_lengths(starts, x.shape[1])
        mean = np.add.reduceat(x, starts, axis=1) / m
        left = x - np.repeat(mean, m.astype(int), axis=1)
        means.append(mean)
        deviations.append(np.sqrt(np.add.reduceat(left * left, starts, axis=1)))
    none = np.empty((len(x), 0))
    return np.hstack([none, *means]), np.hstack([none, *deviations])


def _by_size(lists: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers for each length of list."""
    sizes = np.asarray(lists.value_lengths())
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _matrix(lists: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return np.asarray(lists.take(pa.array(rows)).flatten()).reshape(len(rows), width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, rows in _by_size(batch.column("q")):
            means, deviations = summaries(_matrix(batch.column("q"), rows, size).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, _lists(means), _lists(deviations)],
                                             [*batch.schema.names, "means", "deviations"])


class Block:
    """Vectors of one length with their summaries, smaller ids first."""

    def __init__(self, data: pa.Table, rows: np.ndarray, size: int):
        ids = data.column("vec_id").to_numpy()[rows]
        rows = rows[np.argsort(ids, kind="stable")]
        width = sum(len(x) for x in levels_of(size))
        get = lambda name, n: _matrix(data.column(name).combine_chunks(), rows, n)
        self.rows, self.size = rows, size
        self.ids, self.labels = data.column("vec_id").to_numpy()[rows], data.column("label").to_numpy()[rows]
        self.q, self.means, self.deviations = get("q", size), get("means", width), get("deviations", width)
        self.norms = np.sqrt((self.q.astype(float) ** 2).sum(axis=1))


def bounds(a: Block, b: Block, level: int, of_a: slice, pairs: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible scores at a level, for all pairs of a slice of `a`, or for pairs (row in it, row of b)."""
    starts = levels_of(a.size)
    at = sum(len(x) for x in starts[:level])
    cut = slice(at, at + len(starts[level]))
    ma, da = a.means[of_a, cut] * segment_lengths(starts[level], a.size), a.deviations[of_a, cut]
    mb, db, na = b.means[:, cut], b.deviations[:, cut], a.norms[of_a]
    if pairs is None:
        centre, reach = ma @ mb.T, da @ db.T + 1e-9 * (1 + np.outer(na, b.norms))
    else:
        i, j = pairs
        centre, reach = (ma[i] * mb[j]).sum(axis=1), (da[i] * db[j]).sum(axis=1) + 1e-9 * (1 + na[i] * b.norms[j])
    return centre - reach, centre + reach


def exact(a: np.ndarray, b: np.ndarray, pairs: tuple | None = None) -> np.ndarray:
    """Whole-number inner products; through doubles where these hold every sum exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:
        a, b = a.astype(float), b.astype(float)
    return ((a[pairs[0]] * b[pairs[1]]).sum(axis=1) if pairs else a @ b.T).astype(np.int64)


def search(a: Block, b: Block, windows: list[list[tuple[int, int]]], same_label: bool, top: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each anchor of `a` and each of its windows (least and largest score): its number, the window's number, and
    scores and rows of the `top` best of `b` in the window, best first, smaller ids before larger ones."""
    none = [(0, -1)]
    least, most = (np.array([[f(w[k] for w in ws or none) for f in (min, max)] for ws in windows], float) for k in (0, 1))
    step = max(1, CHUNK_PAIRS // max(1, len(b.ids)))
    for lo in range(0, len(a.ids), step):
        part = slice(lo, min(lo + step, len(a.ids)))
        alike = a.labels[part, None] == b.labels[None, :]
        open_ = (alike & (a.ids[part, None] != b.ids[None, :])) if same_label else ~alike
        open_ &= np.array([bool(ws) for ws in windows[part]])[:, None]
        pairs = None
        for level in range(len(levels_of(a.size))):
            if pairs is None and open_.sum() < SPARSE * open_.size:
                pairs = np.nonzero(open_)
            low, high = bounds(a, b, level, part, pairs)
            if pairs is None:
                sure = np.where(open_ & (low >= least[part, 1:]) & (high <= most[part, :1]), low, -np.inf)
                floor = least[part, :1]
                if len(b.ids) >= top:
                    floor = np.maximum(floor, -np.partition(-sure, top - 1, axis=1)[:, top - 1:top])
                open_ &= (high >= floor) & (low <= most[part, 1:])
            else:
                keep = (high >= least[part][pairs[0], 0]) & (low <= most[part][pairs[0], 1])
                pairs = (pairs[0][keep], pairs[1][keep])
        if pairs is None:
            pairs = np.nonzero(open_)
        dense = len(pairs[0]) > SPARSE * open_.size
        scores = exact(a.q[part], b.q)[pairs] if dense else exact(a.q[part], b.q, pairs)
        ends = np.searchsorted(pairs[0], np.arange(open_.shape[0] + 1))
        for i in range(open_.shape[0]):
            s, rows = scores[ends[i]:ends[i + 1]], pairs[1][ends[i]:ends[i + 1]]
            for w, (first, last) in enumerate(windows[lo + i]):
                inside = np.flatnonzero((s >= first) & (s <= last))
                if len(inside) > top:
                    inside = inside[s[inside] >= -np.partition(-s[inside], top - 1)[top - 1]]
                best = inside[np.argsort(-s[inside], kind="stable")][:top]
                if len(best):
                    yield lo + i, w, s[best], rows[best]


def _found(data: pa.Table, anchors: pa.Table, same_label: bool, top: int) -> pa.Table:
    """anchor_id, h, nth (number of the window), score, vec_id."""
    out = []
    if data.num_rows and anchors.num_rows:
        held = dict(_by_size(data.column("q").combine_chunks()))
        for size, rows in _by_size(anchors.column("q").combine_chunks()):
            if size in held:
                a, b = Block(anchors, rows, size), Block(data, held[size], size)
                keys = anchors.column("h").to_numpy()[a.rows]
                if same_label:
                    windows = [[(-np.inf, np.inf)]] * len(a.ids)
                else:
                    windows = [[(w["least"], w["most"]) for w in ws] for ws in anchors.column("windows").take(pa.array(a.rows)).to_pylist()]
                for i, w, scores, at in search(a, b, windows, same_label, top):
                    n = len(scores)
                    out.append((np.full(n, a.ids[i]), np.full(n, keys[i]), np.full(n, w), scores, b.ids[at]))
    names = ("anchor_id", "h", "nth", "score", "vec_id")
    return pa.table({k: pa.array(np.concatenate([x[j] for x in out]) if out else [], pa.int64()) for j, k in enumerate(names)})


FOUND = "anchor_id bigint, h bigint, nth bigint, score bigint, vec_id bigint"


def _scan(index: DataFrame, anchors: DataFrame, blocks: tuple[int, int], same_label: bool, top: int) -> DataFrame:
    """The best rows of each anchor and window: anchor_id, h, nth, score, vec_id, rank."""
    of_rows, of_anchors = blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "h"), F.lit(n)).cast("int")
    left = index.withColumn("block", dealt(of_rows)).withColumn("anchor_block", every(of_anchors))
    right = anchors.withColumn("anchor_block", dealt(of_anchors)).withColumn("block", every(of_rows))
    keys = ["block", "anchor_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda data, asked: _found(data, asked, same_label, top), FOUND)
    best = Window.partitionBy("anchor_id", "h", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def hard_negatives(spark: SparkSession, rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", label_column: str = "label",
                   vector_column: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its nearest rows of
    the same label, the nearest rows of other labels whose score lies between `low` and `high` hundredths of the positive's.

    `is_anchor` is a condition on vec_id and label."""
    segments, positive_rows = scratch_dir(spark, "segments"), scratch_dir(spark, "positives")
    whole_numbers(rows, id_column, label_column, vector_column).mapInArrow(summarize, INDEX).write.parquet(segments)
    index, anchors = spark.read.parquet(segments), spark.read.parquet(segments).where(is_anchor)

    def block_count(df: DataFrame, least: int) -> int:
        held = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("q") + 1), F.lit(0)).alias("numbers")).first()
        return max(1, -(-held["numbers"] // BLOCK_NUMBERS), min(least, -(-held["n"] // LEAST_ROWS)))

    blocks = block_count(index, spark.sparkContext.defaultParallelism), block_count(anchors, 1)
    _scan(index, anchors, blocks, True, positives).select(
        "anchor_id", "h", (F.col("rank") - 1).cast("bigint").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
    ).write.parquet(positive_rows)
    near = spark.read.parquet(positive_rows)
    # Scores s with low * p <= 100 * s <= high * p, as whole numbers from `least` to `most`; none if p is negative.
    whole = lambda x: f"(({x}) - pmod({x}, 100)) div 100"
    bounds_of = F.struct("nth", F.expr(f"-({whole(f'-positive_score * {low}')})").alias("least"), F.expr(whole(f"positive_score * {high}")).alias("most"))
    windows = near.groupBy("anchor_id", "h").agg(F.array_sort(F.collect_list(bounds_of)).alias("windows"))
    asked = anchors.join(windows.select(F.col("anchor_id").alias("vec_id"), "h", "windows"), ["vec_id", "h"])
    found = _scan(index, asked, blocks, False, negatives)
    return found.join(near, ["anchor_id", "h", "nth"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


@query("op11_hard_negatives", """
WITH parts AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM parts a JOIN parts r ON a.vec_id % 100 = 0 AND len(a.q) = len(r.q) AND (a.label <> r.label OR a.vec_id <> r.vec_id)),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT n.anchor_id, n.positive_id, row_number() OVER (PARTITION BY n.anchor_id, n.positive_id ORDER BY s.score DESC, s.vec_id) AS rank,
    s.vec_id AS negative_id, n.positive_score, s.score AS negative_score
  FROM near n JOIN scores s ON s.anchor_id = n.anchor_id AND NOT s.alike
    AND 30 * n.positive_score <= 100 * s.score AND 100 * s.score <= 90 * n.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10""")
def op11(spark: SparkSession, root: str) -> DataFrame:
    rows = read(spark, root, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(spark, rows, F.col("vec_id") % 100 == 0)
