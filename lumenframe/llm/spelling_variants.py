"""Spelling variant grouping with a frequency-vector trie.

Each word has a vector: its length, then how many of its letters fall into each of 16 groups (code point modulo 16), the
groups of frequent letters first. Two words that differ by one inserted, deleted or replaced code point have vectors with at
most one count higher (surplus) and at most one lower (deficit). Vectors are kept in a trie, one level per count. A depth-first
search walks it with a word's own vector and may spend a surplus of one and a deficit of one; the words at the leaves it reaches
are verified letter by letter. Each pair is found once: from the shorter word, or from the one whose vector is lower where they
first differ, or within one leaf.

The trie is spread by subtrees: the first levels, as many as it takes to have at most `SUBTREE_WORDS` words in each subtree (or
all levels), are a word's address. A word is searched for at its own address and at those that its budget leads to (11 with
three levels), so each task holds one subtree and the words that visit it. A subtree of full depth holds words with equal counts
in all 16 groups and cannot be cut further. In each task, near words are added up per word before they are shuffled.

Words are counted where documents are read, in tables of bounded size, so a word that a third of all rows hold is a few rows.
Forms chain upwards in n (at least doubled in each step), and roots are found by pointer doubling on written tables.

Defined results: null and empty texts have no words; a null id is written as nothing before the colon; repeated rows count
again; ties go to the smaller word in code-point order; words of any length are taken whole; an empty table gives no rows; extra
columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .registry import query, read

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
GROUPS = 16
#: Letter groups from the top of the trie down: those of e, n, i, t, a, r, s, o, l, h, m, g, f, p, k and j.
ORDER = (5, 14, 9, 4, 1, 2, 3, 15, 12, 8, 13, 7, 6, 0, 11, 10)
SUBTREE_WORDS = 50_000
TABLE_WORDS, TABLE_BYTES = 200_000, 64 << 20
CHUNK_PAIRS = 1 << 20
NEAR = "word string, n_near bigint, minus bigint, form string"


def altered(doc_id: object, run: str) -> str:
    """The run as it is counted in a document: by rule, some runs lose a letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, n), each word once per table of bounded size."""
    counts: Counter = Counter()
    held = 0

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            # bytes.lower() touches A-Z only.
            for run, n in Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode() if text.is_valid else "")).items():
                word = altered(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    counts[word] += n
                    held += len(word)
            if len(counts) > TABLE_WORDS or held > TABLE_BYTES:
                yield emit()
                held = 0
    if counts:
        yield emit()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words that occur often enough."""
    found = docs.select("doc_id", "text").mapInArrow(count_words, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of code points (all below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def vectors(words: list[str]) -> np.ndarray:
    """Length and group counts of each word, one row each."""
    out = np.empty((len(words), GROUPS + 1), np.int64)
    out[:, 0] = [len(w) for w in words]
    for length in np.unique(out[:, 0]):
        at = np.flatnonzero(out[:, 0] == length)
        group = codes([words[i] for i in at], int(length)) % GROUPS
        for level, g in enumerate(ORDER, 1):
            out[at, level] = (group == g).sum(axis=1)
    return out


def with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = vectors(batch.column("word").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * (GROUPS + 1), pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "vector"])


def addresses(vector: np.ndarray, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Row numbers, their addresses (length and first counts), and whether it is the rows' own: where a search
    with a surplus and a deficit of one leads, the higher words of each pair being searched for."""
    top, everyone = vector[:, :levels + 1], np.arange(len(vector))

    def moved(up: int | None, down: int | None, longer: int) -> tuple[np.ndarray, np.ndarray, bool]:
        rows = everyone if down is None else np.flatnonzero(top[:, down] > 0)
        out = top[rows].copy()
        out[:, 0] += longer
        if up is not None:
            out[:, up] += 1
        if down is not None:
            out[:, down] -= 1
        return rows, out, False

    yield everyone, top, True
    yield moved(None, None, 1)
    for up in range(1, levels + 1):
        yield moved(up, None, 1)
        yield moved(up, None, 0)
        for down in range(up + 1, levels + 1):
            yield moved(up, down, 0)


def routes(levels: int):
    """(word, n, vector) to (address, own, word, n): where each word lies and where it is searched for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vector = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, GROUPS + 1)
            for rows, address, own in addresses(vector, levels):
                # Equal hashes of different addresses would only put two subtrees into one task.
                key = np.zeros(len(rows), np.uint64)
                for column in address.T:
                    key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.full(len(rows), own)), batch.column("word").take(at), batch.column("n").take(at)],
                    ["address", "own", "word", "n"])
    return run


def build_trie(vector: np.ndarray) -> dict:
    """Nested dictionaries by count, level by level; a leaf is the number of the vector."""
    root: dict = {}
    for i, row in enumerate(vector.tolist()):
        node = root
        for count in row[:-1]:
            node = node.setdefault(count, {})
        node[row[-1]] = i
    return root


def search(trie: dict, vector: list[int], longer: bool) -> Iterator[int]:
    """Depth-first: leaves with one letter more (`longer`), or of equal length and higher where they first differ."""
    start = trie.get(vector[0] + longer)
    if start is None:
        return
    last = len(vector) - 1
    stack = [(start, 1, 1, 0 if longer else 1)]
    while stack:
        node, level, surplus, deficit = stack.pop()
        count = vector[level]
        # A deficit is spent only after the surplus, so that each pair is found from its lower vector.
        for child, up, down in ((node.get(count), surplus, deficit),
                                (node.get(count + 1) if surplus else None, 0, deficit),
                                (node.get(count - 1) if deficit and not surplus else None, surplus, 0)):
            if child is None:
                continue
            if level < last:
                stack.append((child, level + 1, up, down))
            elif not up and not down:
                yield child


def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of `a` and `b` (codes; b as long as a, or one longer) differ by one replacement or insertion."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    same_start = np.cumprod(a == b[:, :n], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    same_end = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return same_start + same_end >= n


def leaf_pairs(vector: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers to verify, in chunks: any row, and a row of the subtree (`own`) that its search reaches."""
    distinct, leaf = np.unique(vector, axis=0, return_inverse=True)
    leaf = leaf.ravel()
    order = np.argsort(leaf, kind="stable")
    ends = np.searchsorted(leaf[order], np.arange(len(distinct) + 1))
    all_rows = [order[ends[i]:ends[i + 1]] for i in range(len(distinct))]
    own_rows = [r[own[r]] for r in all_rows]
    here = np.array([i for i, r in enumerate(own_rows) if len(r)])
    trie = build_trie(distinct[here])
    a, b, held = [], [], 0
    for i, row in enumerate(distinct.tolist()):
        for longer in (False, True):
            targets = [own_rows[here[j]] for j in search(trie, row, longer)]
            if targets:
                found = np.concatenate(targets)
                # At most CHUNK_PAIRS pairs and one word's candidates at a time.
                step = max(1, CHUNK_PAIRS // len(found))
                for lo in range(0, len(all_rows[i]), step):
                    part = all_rows[i][lo:lo + step]
                    a.append(np.repeat(part, len(found)))
                    b.append(np.tile(found, len(part)))
                    held += len(a[-1])
                    if held > CHUNK_PAIRS:
                        yield np.concatenate(a), np.concatenate(b)
                        a, b, held = [], [], 0
        mine = own_rows[i]
        for at in range(len(mine) - 1):
            a.append(np.full(len(mine) - at - 1, mine[at]))
            b.append(mine[at + 1:])
            held += len(b[-1])
            if held > CHUNK_PAIRS:
                yield np.concatenate(a), np.concatenate(b)
                a, b, held = [], [], 0
    if a:
        yield np.concatenate(a), np.concatenate(b)


def near_words(group: pa.Table) -> pa.Table:
    """All near pairs of a subtree's words and its visitors, added up per word: n_near, and the best near word as minus its n
    and itself (`form`)."""
    words, counts, own = group.column("word").to_pylist(), group.column("n").to_numpy(), group.column("own").to_numpy(zero_copy_only=False)
    if not own.any():
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "minus": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    vector = vectors(words)
    lengths = vector[:, 0]
    place, matrices = np.empty(len(words), np.int64), {}
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        place[at] = np.arange(len(at))
        matrices[length] = codes([words[i] for i in at], int(length))
    first, second = [], []
    for a, b in leaf_pairs(vector, own):
        for la in np.unique(lengths[a]):
            for lb in (la, la + 1):
                mine = np.flatnonzero((lengths[a] == la) & (lengths[b] == lb))
                if len(mine):
                    step = max(1, (CHUNK_PAIRS * 16) // int(lb))
                    for lo in range(0, len(mine), step):
                        at = mine[lo:lo + step]
                        at = at[verified(matrices[la][place[a[at]]], matrices[lb][place[b[at]]])]
                        first.append(a[at])
                        second.append(b[at])
    x = np.concatenate([*first, *second]) if first else np.empty(0, np.int64)
    y = np.concatenate([*second, *first]) if first else np.empty(0, np.int64)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[y], -counts[y], x))
    x, y = x[order], y[order]
    start = np.flatnonzero(np.diff(x, prepend=-1))
    n_near = np.diff(np.append(start, len(x)))
    return pa.table({"word": pa.array([words[i] for i in x[start]], pa.string()), "n_near": pa.array(n_near, pa.int64()),
                     "minus": pa.array(-counts[y[start]], pa.int64()), "form": pa.array([words[i] for i in y[start]], pa.string())})


def spelling_variants(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """counts: word, n (words distinct). Adds n_near, form, form_n and root."""
    def stored(name: str, df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    words = stored("words", counts.select("word", "n").mapInArrow(with_vectors, "word string, n bigint, vector array<bigint>"))
    levels = 0
    while levels < GROUPS:
        address = F.slice("vector", 1, levels + 1)
        largest = words.groupBy(address.alias("a")).count().agg(F.max("count")).first()[0] or 0
        if largest <= SUBTREE_WORDS:
            break
        levels += 1
    dealt = words.mapInArrow(routes(levels), "address bigint, own boolean, word string, n bigint")
    near = dealt.groupBy("address").applyInArrow(near_words, NEAR)
    alone = words.select("word", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("minus"), F.lit(None).cast("string").alias("form"), "n")
    both = near.withColumn("n", F.lit(None).cast("bigint")).unionByName(alone)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("minus", "form")))
    summed = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    wins = -F.col("best.minus") >= 2 * F.col("n")
    formed = stored("forms", summed.select("word", "n", "n_near", F.when(wins, F.col("best.form")).alias("form"), F.when(wins, -F.col("best.minus")).alias("form_n")))
    # Pointer doubling: after k rounds a pointer spans 2^k forms, or leads to the last.
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        nxt = up.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        stepped = stored("roots", up.join(nxt, "root", "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        up = stepped.select("word", "root")
        if stepped.where("_moved").isEmpty():
            break
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13(spark: SparkSession, root: str) -> DataFrame:
    return spelling_variants(spark, word_counts(read(spark, root, "documents")))
