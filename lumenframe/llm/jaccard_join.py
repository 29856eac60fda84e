"""N-gram Jaccard join: a size-aware join, light sets by subsets, heavy sets by inverted lists.

A document is the set of its word shingles. Two sets of sizes s and t reach the similarity when they share
c(s, t) = ceil(r (s + t) / (1 + r)) elements. Sets of at most `boundary` elements are light: each lists its
subsets of c elements for every partner size, and equal subsets link their holders, who then all link with
each other, so a star is enough. All other pairs come from inverted lists. The boundary has the least cost, in
rows, over the sizes that are there: subsets of light sets against list entries of heavy ones.

No pairs within large groups, and no loss of links:
- equal sets are one class;
- a set stays in the join only if enough of its smallest hashes occur in another set (the prefix lemma with l
  common elements; hashes are cut to 32 bits inside a bucket, which can only keep more);
- lists are scanned in rounds: in each round a set scans one list (its smallest element under that round's
  hash) against one holder, checked exactly; found links make components; further rounds take several holders of
  other components;
- last, lists of the rarest elements (prefix lemma) are scanned for pairs of different components; the smaller
  set of a pair is indexed by a shorter prefix, and bounds from ranks and parity bits drop pairs before they leave
  the join. Sets that share too little with other components were left out by the same lemma before.

Defined results: null text, no words or an empty table give an empty set or no rows; empty sets link with nothing;
a row without an id links with nothing and is its own component; rows with one id are one document; extra columns
are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .components import components
from .perfect_hash import mix
from .registry import query, read

WORDS = 5
SIMILARITY = (75, 100)
ROUNDS = 3
MORE_ROUNDS = 8
BUCKET_HASHES = 4_000_000
KEPT_WORDS = 400_000
PARITY_BITS = 512
#: Odd factors of a word's place in its shingle.
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def _stored(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    df.write.parquet(path := scratch_dir(spark, name))
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, table: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, white space \x20\x09-\x0D only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, found), np.uint64, len(found))
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(found))], np.uint64)
    total = np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        total += h[i:len(h) - words + 1 + i] * np.uint64(_factor(i))
    return np.unique(mix(total, 0))


def _factor(i: int) -> int:
    return FACTORS[i] if i < len(FACTORS) else xxhash.xxh3_64_intdigest(str(i).encode()) | 1


def required(s: int, t: int, r=SIMILARITY) -> int:
    """Shared elements that two sets need: the least i with r1 i >= r0 (s + t - i)."""
    return -(-r[0] * (s + t) // (r[0] + r[1]))


def least_overlap(n: np.ndarray, r=SIMILARITY) -> np.ndarray:
    """Shared elements that a set of n needs with any partner."""
    return -(-n * r[0] // r[1])


def similar(a: np.ndarray, b: np.ndarray, r=SIMILARITY) -> bool:
    if min(len(a), len(b)) * r[1] < max(len(a), len(b)) * r[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return r[1] * both >= r[0] * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    table = WordHashes()
    for batch in batches:
        yield batch.column(0), [shingles(t.as_py(), table, words) for t in batch.column(1)]


def set_classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs: id, text. Per row: id, n (set size) and the set's 128-bit digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, words):
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], ["id", "n", "high", "low"])
    return docs.mapInArrow(run, "id bigint, n bigint, high bigint, low bigint")


def _prefix(s: np.ndarray) -> tuple[int, int]:
    """Length of the prefix, and how many of its elements another set must share."""
    need = int(least_overlap(np.int64(len(s))))
    share = max(1, need // 3)
    return len(s) - need + share, share


def needed_share(n):
    """The second of `_prefix` as a column."""
    need = F.ceil(n * F.lit(SIMILARITY[0]) / F.lit(SIMILARITY[1]))
    return F.greatest(F.lit(1), F.floor(need / 3))


def _packed(owners: list[int], groups: list[int], sets: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Prefix elements by bucket: 32 bits each, with runs of one owner's elements. Each owner belongs to a group."""
    parts = [s[:_prefix(s)[0]] for s in sets]
    if not any(len(p) for p in parts):
        return
    h = np.concatenate(parts)
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    h, of, bucket = (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), of[order], bucket[order]
    run = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])]))
    length = np.diff(np.append(run, len(h))).astype("<u4")
    owner, group = np.array(owners, np.int64)[of[run]], np.array(groups, np.int64)[of[run]]
    names, first = np.unique(bucket, return_index=True)
    cuts = list(zip(first, np.append(first[1:], len(h))))
    runs = [(np.searchsorted(run, x), np.searchsorted(run, y)) for x, y in cuts]
    yield pa.RecordBatch.from_arrays([
        pa.array(names), pa.array([h[x:y].tobytes() for x, y in cuts], pa.binary()), *(
            pa.array([values[x:y].tobytes() for x, y in runs], pa.binary()) for values in (owner, group, length))], ["bucket", "hashes", "owners", "groups", "lengths"])


PACKED = "bucket int, hashes binary, owners binary, groups binary, lengths binary"


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in column])


def _shared(rows: pa.Table, slots: int) -> pa.Table:
    """By slot: owners and how many of their elements in this bucket another group holds too."""
    lengths = _joined(rows.column("lengths"), "<u4")
    names, first, code = np.unique(_joined(rows.column("owners"), "<i8"), return_index=True, return_inverse=True)
    group = _joined(rows.column("groups"), "<i8")[first]
    h = _joined(rows.column("hashes"), "<u4").astype(np.uint64)
    pair = np.unique(h << np.uint64(32) | np.repeat(code, lengths).astype(np.uint64))
    h, code = pair >> np.uint64(32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    of = group[code]
    several = np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)
    n = np.bincount(code[np.repeat(several, np.diff(np.append(start, len(h))))], minlength=len(names))
    names, n = names[n > 0], n[n > 0]
    slot = (mix(names.view(np.uint64), 5) % np.uint64(slots)).astype(np.int32)
    order = np.argsort(slot, kind="stable")
    names, n, slot = names[order], n[order].astype("<u4"), slot[order]
    found, first = np.unique(slot, return_index=True)
    cuts = list(zip(first, np.append(first[1:], len(slot))))
    return pa.table({"slot": pa.array(found), "names": pa.array([names[x:y].tobytes() for x, y in cuts], pa.binary()), "counts": pa.array([n[x:y].tobytes() for x, y in cuts], pa.binary())})


def _added(rows: pa.Table) -> pa.Table:
    names, at = np.unique(_joined(rows.column("names"), "<i8"), return_inverse=True)
    n = np.bincount(at, _joined(rows.column("counts"), "<u4"), len(names))
    return pa.table({"name": pa.array(names), "n_shared": pa.array(n.astype(np.int64))})


def shared_counts(packed: DataFrame, slots: int) -> DataFrame:
    """name, n_shared: an upper bound of the elements of the prefix that other groups hold."""
    partial = packed.groupBy("bucket").applyInArrow(lambda t: _shared(t, slots), "slot int, names binary, counts binary")
    return partial.groupBy("slot").applyInArrow(_added, "name bigint, n_shared bigint")


def choose_boundary(sizes: dict[int, int], most: int = 16) -> int:
    """The largest light size: the least rows of subsets plus list entries. sizes: sets by size, up to a bounded size."""
    best, cost = 0, None
    for x in range(0, most + 1):
        light = sum(n * math.comb(s, required(*sorted((s, t)))) for s, n in sizes.items() if s <= x
                    for t in range(1, x + 1) if min(s, t) * SIMILARITY[1] >= max(s, t) * SIMILARITY[0])
        heavy = sum(n * s for s, n in sizes.items() if s * SIMILARITY[1] >= (x + 1) * SIMILARITY[0])
        if cost is None or light + heavy < cost:
            best, cost = x, light + heavy
    return best


def light_links(sets: DataFrame, boundary: int) -> DataFrame:
    """sets: id, n, hashes. Links a, b between light sets with a subset in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, second, side = [], [], [], []
            for i, blob in zip(batch.column("id"), batch.column("hashes")):
                h = np.frombuffer(blob.as_py(), np.uint64)
                s = len(h)
                for t in range(1, boundary + 1):
                    if min(s, t) * SIMILARITY[1] < max(s, t) * SIMILARITY[0]:
                        continue
                    for subset in itertools.combinations(h.tolist(), required(*sorted((s, t)))):
                        key = np.array([min(s, t), max(s, t), *subset], np.uint64).tobytes()
                        a, b = np.frombuffer(xxhash.xxh3_128_digest(key), np.int64)
                        ids.append(i.as_py())
                        first.append(a)
                        second.append(b)
                        side.append(int(s > t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(side, pa.int32())], ["id", "k1", "k2", "side"])

    rows = sets.where(F.col("n") <= boundary).select("id", "hashes").mapInArrow(run, "id bigint, k1 bigint, k2 bigint, side int")
    # Side 1 is the larger set of two sizes; with equal sizes all are on side 0 and the star is around the smallest.
    heads = rows.groupBy("k1", "k2").agg(F.min(F.when(F.col("side") == 0, F.col("id"))).alias("small"), F.min(F.when(F.col("side") == 1, F.col("id"))).alias("large"), F.count("*").alias("m")).where("m > 1")
    joined = rows.join(heads, ["k1", "k2"])
    return joined.select(F.col("id").alias("a"), F.when(F.col("side") == 1, F.col("small")).otherwise(F.coalesce("large", "small")).alias("b")).where("b is not null and a <> b").distinct()


def parities(h: np.ndarray) -> np.ndarray:
    """How often, modulo 2, the elements fall on each of `PARITY_BITS` places."""
    odd = np.bincount(((h >> np.uint64(7)) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


PARITIES = [f"p{k}" for k in range(PARITY_BITS // 64)]


def set_parities(sets: DataFrame) -> DataFrame:
    """sets: id, n, hashes. id, n and the parities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [parities(np.frombuffer(x.as_py(), np.uint64)).tolist() for x in batch.column("hashes")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *(pa.array([w[k] for w in words], pa.int64()) for k in range(len(PARITIES)))], ["id", "n", *PARITIES])
    return sets.select("id", "n", "hashes").mapInArrow(run, ", ".join(f"{c} bigint" for c in ["id", "n", *PARITIES]))


def _need(left: str, right: str):
    """Shared elements that two sets need, as a column. left, right: aliases of tables with n."""
    low, high = SIMILARITY
    return F.ceil((F.col(f"{left}.n") + F.col(f"{right}.n")) * low / (low + high))


def _close(left: str, right: str):
    """Whether the parities differ in no more places than the sets may in elements."""
    apart = sum(F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in PARITIES)
    return apart <= F.col(f"{left}.n") + F.col(f"{right}.n") - 2 * _need(left, right)


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: a, b. Those whose sizes and parities allow it, so that hashes are moved for these only."""
    low, high = SIMILARITY
    marks = set_parities(sets)
    joined = pairs.join(marks.alias("l"), F.col("a") == F.col("l.id")).join(marks.alias("r"), F.col("b") == F.col("r.id"))
    sizes = F.least("l.n", "r.n") * high >= F.greatest("l.n", "r.n") * low
    return joined.where(sizes & _close("l", "r")).select("a", "b").distinct()


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: a, b. Those that are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def round_links(sets: DataFrame, rounds: int) -> DataFrame:
    """Links between each set and one holder of its list, in each round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("hashes")]
            for k in range(rounds):
                keys = np.array([mix(h, 101 + k).min() if len(h) else 0 for h in hashes], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), batch.column("id")], ["round", "key", "id"])

    entries = sets.select("id", "hashes").mapInArrow(run, "round int, key bigint, id bigint")
    # Even rounds take the smallest holder, odd rounds any other, so that one unlucky holder does not decide.
    order = F.when(F.col("round") % 2 == 0, F.col("id")).otherwise(F.xxhash64("round", "id"))
    heads = entries.groupBy("round", "key").agg(F.min_by("id", order).alias("head"), F.count("*").alias("m")).where("m > 1").select("round", "key", "head")
    pairs = entries.join(heads, ["round", "key"]).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    return _checked(_possible(pairs, sets), sets)


def more_links(sets: DataFrame, rounds: int) -> DataFrame:
    """sets: id, n, root, hashes. Further rounds, with several holders of each list, between different components only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("hashes")]
            for k in range(rounds):
                keys = np.array([mix(h, 201 + k).min() if len(h) else 0 for h in hashes], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), batch.column("id"), batch.column("root")], ["round", "key", "id", "root"])

    entries = sets.select("id", "root", "hashes").mapInArrow(run, "round int, key bigint, id bigint, root bigint")
    at = F.struct("id", "root")
    holders = F.array(F.min(at), *[F.min_by(at, F.xxhash64(F.lit(k), "round", "id")) for k in range(3)])
    heads = (entries.groupBy("round", "key").agg(holders.alias("heads"), F.min("root").alias("r0"), F.max("root").alias("r1"))
             .where("r0 < r1").select("round", "key", F.explode(F.array_distinct("heads")).alias("head")))
    pairs = entries.join(heads, ["round", "key"]).where(F.col("root") != F.col("head.root")).select(F.col("id").alias("a"), F.col("head.id").alias("b")).distinct()
    return _checked(_possible(pairs, sets), sets)


def rare_elements(sets: DataFrame) -> DataFrame:
    """sets: id, n, root, hashes. The prefix of each set: h, its rank, the rarer elements, and the set's root and parities.

    The order is one for all sets: elements held by one component only, which link nothing, come first, then rare ones.
    The former are not moved: what lacks in a set's n are such elements. (Where rows share id and n, ranks come out
    too small, which keeps more.)
    """
    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("hashes")]
            at = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)), *(c.take(pa.array(at)) for c in batch.select(["id", "n", "root"]).columns)], ["h", "id", "n", "root"])

    from pyspark.sql import Window

    low, high = SIMILARITY
    entries = sets.select("id", "n", "root", "hashes").mapInArrow(elements, "h bigint, id bigint, n bigint, root bigint")
    lists = entries.groupBy("h").agg(F.count("*").alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("h", "df")
    own = Window.partitionBy("id", "n")
    rank = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h"))
    rare = entries.join(lists, "h").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * low / high) + 1)
    rarer = own.orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    rare = rare.withColumn("rarer", F.collect_list("h").over(rarer)).select("h", "id", "n", "root", "rank", "rarer")
    # Joined on the keys of the windows, so that lists are not shuffled for it.
    return rare.join(set_parities(sets), ["id", "n"])


def list_links(sets: DataFrame, boundary: int) -> DataFrame:
    """sets: id, n, root, hashes. Links between sets of different components that share a rare element of both.

    The first common element of a linked pair is among the first n - ceil(2 r n / (1 + r)) + 1 of the smaller set, which
    alone are indexed, and the first n - ceil(r n) + 1 of the larger one. A pair is met at that element only, and stays if
    enough elements are left behind it in both sets, and if the parities differ in no more places than the sets may in
    elements.
    """
    low, high = SIMILARITY
    rare = _stored(sets.sparkSession, "rare", rare_elements(sets))  # read twice
    left, right = rare.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * (2 * low) / (low + high)) + 1).alias("l"), rare.alias("r")
    near = (F.col("l.n") * high >= F.col("r.n") * low) & (F.struct("l.n", "l.id") < F.struct("r.n", "r.id")) & (F.col("r.n") > boundary)
    left_over = F.least(F.col("l.n") - F.col("l.rank"), F.col("r.n") - F.col("r.rank")) + 1 >= _need("l", "r")
    # A pair comes from the first list that both are in, not from every one.
    first = ~F.arrays_overlap("l.rarer", "r.rarer")
    pairs = (left.join(right, (F.col("l.h") == F.col("r.h")) & (F.col("l.root") != F.col("r.root")) & near & left_over & _close("l", "r") & first)
             .select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct())
    return _checked(pairs, sets)


def similar_documents(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, rep_id (smallest document with the same set)."""
    slim = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    store = functools.partial(_stored, spark)
    rows = store("set-rows", set_classes(slim, words))
    reps = rows.where("id is not null and n > 0").groupBy("high", "low").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-total // BUCKET_HASHES))

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, words):
            names = [int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[1]) for s in sets]
            once = {k: s for k, s in zip(names, sets)}
            yield from _packed(list(once), list(once), list(once.values()), buckets)

    counts = shared_counts(slim.where("id is not null").mapInArrow(pack_rows, PACKED), buckets)
    joining = store("joining", reps.join(counts, reps["low"] == counts["name"]).where(F.col("n_shared") >= needed_share(F.col("n"))).select(F.col("rep").alias("id")).distinct())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "hashes"])

    sets = store("sets", slim.join(joining, "id", "left_semi").mapInArrow(hashed, "id bigint, n bigint, hashes binary").where("n > 0"))
    sizes = {r["n"]: r["m"] for r in sets.where("n <= 64").groupBy("n").agg(F.count("*").alias("m")).collect()}
    boundary = choose_boundary(sizes)
    heavy = sets.where(F.col("n") * SIMILARITY[1] >= (boundary + 1) * SIMILARITY[0])
    links = store("links-light", light_links(sets, boundary)).unionByName(store("links-rounds", round_links(heavy, ROUNDS)))

    def pack_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _packed(batch.column("id").to_pylist(), batch.column("root").to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("hashes")], buckets)

    def crossing(left: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sets that share enough with sets of other components, with their root; the components as links to roots."""
        stars = components(spark, links)
        rooted = store("rooted", left.join(stars.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
        counts = shared_counts(rooted.select("id", "root", "hashes").mapInArrow(pack_roots, PACKED), buckets)
        kept = rooted.join(counts, F.col("id") == F.col("name")).where(F.col("n_shared") >= needed_share(F.col("n")))
        return store("crossing", kept.select("id", "n", "root", "hashes")), stars.select(F.col("node").alias("a"), F.col("root").alias("b"))

    # A set left out here shares too little with other components, and components only grow.
    first, stars = crossing(heavy, links)
    second, stars = crossing(first.drop("root"), stars.unionByName(store("links-more", more_links(first, MORE_ROUNDS))))
    final = components(spark, stars.unionByName(store("links-last", list_links(second, boundary))))
    named = rows.join(reps.select("high", "low", "rep"), ["high", "low"], "left")
    named = named.withColumn("rep", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("rep")).otherwise(F.col("id")))
    done = named.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return done.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"), F.col("rep").alias("rep_id"))


@query("op5_jaccard_join", r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets GROUP BY ALL),
elements AS (SELECT rep, len(s) AS n, unnest(s) AS e FROM classes),
common AS (
    SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c
    FROM elements a JOIN elements b ON a.e = b.e AND a.rep < b.rep GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 75 * (m + n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
roots AS (SELECT x, least(x, min(y)) AS root FROM reach GROUP BY x)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
    CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE coalesce(root, rep) END AS component_id
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN roots ON roots.x = classes.rep
""")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return similar_documents(spark, read(spark, root, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
