"""Language ID by prediction by partial matching.

For each language the n-grams of bytes up to `order` + 1 form a context tree. A byte's code length under a
language is found at the longest context that has seen it: counts c of the byte, t of all bytes and d of
distinct bytes there give probability c / (t + d); each longer context that exists costs an escape of
probability d / (t + d); below the empty context all 256 bytes are equal. Statistics stay frozen while a text
is scored, so a code length depends on the last `order` + 1 bytes only: each node of the joint tree gets one
row with the costs of its byte and of its later use as a context, for all languages, and the code length
of a text is a sum of such rows. That sum is exact. The language with the shortest code wins; the score is its
share of the posterior under equal priors.

Training: the tree is learned from at most `sample_rows` texts per language (those with the smallest hash
of their text), each counted whole, in Spark. Grams seen less than `LEAST_COUNT` times there are left out of
the trees. This sample is the only bounded part; every text is scored whole.

Defined results: null text or no letter: `und` with score 0; null languages teach nothing; a null id is
not held out; ties go to the language that sorts first; with nothing to learn from all texts are `und`;
texts of a batch are joined, so very long texts need memory for one text only; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .perfect_hash import mix
from .registry import query, read

ORDER = 4
SAMPLE_ROWS = 400
LEAST_COUNT = 2
CHUNK = 100_000
LETTER = regex.compile(r"\p{L}")


def gram_codes(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the `width` bytes ending at each position, and which positions have so many in their own text."""
    codes = np.zeros(len(data), np.uint64)
    for back in range(width - 1, -1, -1):
        codes = codes << np.uint64(8)
        codes[back:] |= data[:len(data) - back]
    # code = byte[i-width+1] first ... byte[i] last, with the width in the top byte
    offset = np.arange(len(data)) - starts
    return codes | np.uint64(width << 56), offset >= width - 1


class ContextTrees:
    """The joint tree of all languages: an open hash table from gram codes to rows of costs in bits."""

    def __init__(self, languages: list[str], order: int, codes: np.ndarray, counts: np.ndarray):
        """counts: one row per code, one column per language."""
        self.languages, self.order = languages, order
        at = np.argsort(codes)
        codes, counts = codes[at], counts[at].astype(np.float64)
        width = (codes >> np.uint64(56)).astype(np.int64)
        body = codes & np.uint64((1 << 56) - 1)

        def find(code: np.ndarray) -> np.ndarray:
            return np.searchsorted(codes, code)

        # The context of a gram is its bytes but the last; its suffix lacks the first byte.
        long = width > 1
        context = np.full(len(codes), -1)
        context[long] = find((body[long] >> np.uint64(8)) | ((width[long] - 1).astype(np.uint64) << np.uint64(56)))
        suffix = np.full(len(codes), -1)
        mask = (np.uint64(1) << (np.uint64(8) * (width - 1).astype(np.uint64))) - np.uint64(1)
        suffix[long] = find((body[long] & mask[long]) | ((width[long] - 1).astype(np.uint64) << np.uint64(56)))
        total, kinds = np.zeros((len(codes) + 1, len(languages))), np.zeros((len(codes) + 1, len(languages)))
        under = np.where(context < 0, len(codes), context)  # the last row is the empty context
        for k in range(len(languages)):
            total[:, k] = np.bincount(under, counts[:, k], len(codes) + 1)
            kinds[:, k] = np.bincount(under, counts[:, k] > 0, len(codes) + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        # Sum of the escapes of a context and of all its suffixes down to the empty one, which is the last row.
        escapes = np.zeros((len(codes) + 1, len(languages)))
        escapes[-1] = escape[-1]
        cost = np.zeros((len(codes), len(languages)))
        for w in range(1, order + 2):
            rows = np.flatnonzero(width == w)
            up = context[rows]
            escapes[rows] = escape[rows] + escapes[suffix[rows]]
            shorter = cost[suffix[rows]] if w > 1 else np.full((len(rows), len(languages)), 8.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(counts[rows] / (total[up] + kinds[up]))
            cost[rows] = np.where(counts[rows] > 0, seen, escape[up] + shorter)
        # A byte pays the escapes of all contexts before it (`later` of the node before), less those up to the
        # context where it was found (`own`). A byte without any gram is found below the empty context; last row.
        self.own = np.vstack([cost - escapes[context], np.full(len(languages), 8.0)])
        self.later = np.vstack([escapes[np.where(width <= order, np.arange(len(codes)), suffix)], escapes[-1]])
        self.both = self.own + self.later
        self.start = escapes[-1]
        self._hash(codes)

    def _hash(self, codes: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(len(codes), 1) * 4))))
        self.shift = np.uint64(64 - bits)
        self.slots, self.rows = np.zeros((1 << bits) + 64, np.uint64), np.zeros((1 << bits) + 64, np.int32)
        home = (mix(codes, 0) >> self.shift).astype(np.int64)
        left, step = np.arange(len(codes)), 0
        while len(left):
            if step >= 64:
                raise ValueError("hash table too full")
            at = home[left] + step
            free = np.flatnonzero(self.slots[at] == 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[first]], self.rows[at[first]] = codes[left[first]], left[first]
            left, step = np.delete(left, first), step + 1
        self.steps = max(step, 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Rows of codes, -1 where there is none."""
        at = (mix(codes, 0) >> self.shift).astype(np.int64)
        out = np.where(self.slots[at] == codes, self.rows[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.slots[at] != 0))
        for step in range(1, self.steps):
            if not len(open_):
                break
            found = self.slots[at[open_] + step]
            hit = found == codes[open_]
            out[open_[hit]] = self.rows[at[open_[hit]] + step]
            open_ = open_[~hit & (found != 0)]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        group, size = [], 0
        for i, text in enumerate(texts):
            if size and size + len(text) > CHUNK:
                self._add(out, texts, group)
                group, size = [], 0
            group.append(i)
            size += len(text)
        self._add(out, texts, group)
        return out

    def _add(self, out: np.ndarray, texts: list[bytes], group: list[int]) -> None:
        group = [i for i in group if texts[i]]
        if not group:
            return
        sizes = np.array([len(texts[i]) for i in group])
        joined = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        if len(group) == 1:  # a very long text goes piece by piece, each with the bytes before it that its contexts need
            row = np.zeros(len(self.languages))
            for lo in range(0, len(joined), CHUNK):
                back = min(lo, self.order)
                rows = self._nodes(joined[lo - back:lo + CHUNK], np.zeros(1, np.int64))
                row += self.both[rows[back:]].sum(axis=0)
            out[group[0]] = row + self.start - self.later[rows[-1]]
            return
        rows = self._nodes(joined, begin)
        out[group] = np.add.reduceat(self.both[rows], begin, axis=0) + self.start - self.later[rows[ends - 1]]

    def _nodes(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The row of the longest known gram that ends at each byte and lies within its text."""
        top = self.order + 1
        data = data.astype(np.uint64)
        codes = np.zeros(len(data), np.uint64)
        for back in range(top):
            codes[back:] |= data[:len(data) - back] << np.uint64(8 * back)
        room = np.full(len(data), top, np.uint8)  # bytes of the same text up to here
        for k in range(self.order - 1, -1, -1):  # a short text's start must win over the tail of the one before
            at = begin + k
            room[at[at < len(data)]] = k + 1
        return self._longest(codes, room)

    def _longest(self, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
        rows = np.full(len(codes), len(self.own) - 1)
        open_ = np.arange(len(codes))
        for width in range(self.order + 1, 0, -1):
            able = open_ if width == 1 else open_[room[open_] >= width]
            found = self.find(codes[able] & np.uint64((1 << 8 * width) - 1) | np.uint64(width << 56))
            rows[able[found >= 0]] = found[found >= 0]
            open_ = open_[rows[open_] == len(self.own) - 1]
        return rows

def count_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram codes of all widths up to order + 1 and their counts."""
    texts = [t for t in texts if t]
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    starts = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    parts = []
    for width in range(1, order + 2):
        codes, whole = gram_codes(data, starts, width)
        parts.append(np.unique(codes[whole], return_counts=True))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def learn(labelled: DataFrame, order: int = ORDER, sample_rows: int = SAMPLE_ROWS) -> ContextTrees | None:
    """labelled: lang, text. Trees of a bounded sample; None without any."""
    from pyspark.sql import Window

    rows = labelled.where("lang is not null and text is not null")
    keyed = rows.select("lang", F.xxhash64("text").alias("pick")).distinct()  # copies count once
    picked = (keyed.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("pick"))).where(F.col("nth") <= sample_rows)
              .groupBy("lang").agg(F.max("pick").alias("last")))
    last = {r["lang"]: r["last"] for r in picked.collect()}
    if not last:
        return None
    limits = F.create_map(*[x for k, v in last.items() for x in (F.lit(k), F.lit(v))])
    sample = rows.where(F.xxhash64("text") <= limits[F.col("lang")]).dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                codes, n = count_grams([t.encode() for t in part["text"]], order)
                yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})

    languages = sorted(last)
    grams = sample.select("lang", "text").mapInPandas(count, "lang string, code bigint, n bigint")
    each = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(languages)]
    # Bounded by the sample: the grams of at most `sample_rows` texts of each language.
    found = grams.groupBy("code").agg(F.sum("n").alias("n"), *each).where(F.col("n") >= LEAST_COUNT).drop("n").toArrow()
    codes = found.column("code").to_numpy().view(np.uint64)
    counts = np.stack([found.column(f"n{i}").to_numpy() for i in range(len(languages))], axis=1)
    return ContextTrees(languages, order, codes, counts)


def predict(spark: SparkSession, trees: ContextTrees | None, text: Column) -> Column:
    """struct(lang_pred, score, bits_per_byte)."""
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            known = np.array([bool(t and LETTER.search(t)) and model is not None for t in texts], bool)
            out = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "bits_per_byte": np.nan})
            if known.any():
                data = [t.encode() for t in texts[known]]
                bits = model.bits(data)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                out.loc[known, "lang_pred"] = [model.languages[i] for i in best]
                out.loc[known, "score"] = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
                out.loc[known, "bits_per_byte"] = least / np.array([len(t) for t in data])
            yield out
    return run(text)


def with_language(spark: SparkSession, docs: DataFrame, trees: ContextTrees | None, text_column: str = "text") -> DataFrame:
    """All rows and columns, with lang_pred, score and bits_per_byte (columns of these names are replaced)."""
    done = docs.withColumn("_pred", predict(spark, trees, F.col(text_column)))
    return done.withColumns({c: F.col(f"_pred.{c}") for c in ("lang_pred", "score", "bits_per_byte")}).drop("_pred")


def held_out(doc_id: Column) -> Column:
    """Documents that teach nothing, for measuring accuracy."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_documents(docs: DataFrame) -> ContextTrees | None:
    return learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))


@query("op2_language_id")
def op2(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    done = with_language(spark, docs.select("doc_id", "text"), learn_documents(docs))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
