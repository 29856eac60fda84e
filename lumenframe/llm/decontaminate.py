"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with each run of white space as one blank. A benchmark item is cut into
overlapping windows of `window` characters (a shorter item is one window); a window of m characters may differ
by k = error * m edits. By the q-gram lemma a region within k edits shares at least m - q + 1 - k q q-grams with
the window, on diagonals that differ by at most k. So shared q-grams are counted in diagonal bands of width
2 (k + 1), each overlapping the next by half: every such region fills one band. Bands with enough q-grams are
verified by a banded alignment. Any text that holds 1.5 windows of an item in a row within the error is found.
Shorter passages are found by short windows of `SHORT` characters that start every `SHORT_STEP`, with a smaller
error: any SHORT + SHORT_STEP - 1 = 59 characters of an item in a row, wherever they start, with at most
SHORT * SHORT_ERROR = 3 edits. An item of at most SHORT characters must occur whole, within the error.

The benchmark comes in blocks of bounded size, each sent to all tasks; there is one pass over the documents per
block, however large the benchmark is. Documents are only read, never shuffled. Texts are scanned whole, in
pieces that overlap by more than a window.

Defined results: null and empty texts hold nothing; empty items match nothing; an item with a null id is reported
with a null id; items with equal texts are all reported; items shorter than q characters must occur exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .perfect_hash import mix
from .registry import query, read

Q = 8
WINDOW = 100
ERROR = 0.1
SHORT = 50
SHORT_STEP = 10
SHORT_ERROR = 0.06
BLOCK_CHARS = 2_000_000
PIECE = 300_000
BITS = 22
BREAK = 0x7FFFFFFF
HITS = "array<struct<item_id:bigint,n_windows:int,edits:int,start:bigint,stop:bigint>>"
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _fold_table() -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1 and ord(low) < 0x10000:
            table[c] = ord(low)
    table[_SPACES] = 32
    return table


FOLD = _fold_table()


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters, and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = FOLD[codes] if codes.max(initial=0) < 0x10000 else np.where(codes < 0x10000, FOLD[np.minimum(codes, 0xFFFF)], codes)
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return codes[at], at


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q characters that start at each place but the last Q - 1."""
    h = codes.astype(np.uint64)
    width = 1
    while width < Q:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:] if len(h) > width else h[:0]
        h ^= h >> np.uint64(29)
        width *= 2
    return mix(h, 0)


class Grams:
    """The index of the q-grams of windows that are looked for with one error."""

    def __init__(self, items: list[int], codes: list[np.ndarray], error: float):
        self.items, self.codes = items, codes
        size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum((size * error).astype(np.int64), np.maximum(size - Q, 0) // Q)
        self.least = size - Q + 1 - self.edits * Q
        self.size = size
        grams = [gram_hashes(c) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.reach = int((size + self.edits).max()) if len(size) else 0
        self.fewest = int(self.least.min()) if len(size) else 0

    def find(self, codes: np.ndarray, h: np.ndarray, hit: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Per window: (start, stop, edits) of regions in the characters. hit: places, in order, of hashes h that may be known."""
        out = defaultdict(list)
        if not len(self.keys) or len(hit) < self.fewest:
            return out
        # A region has at least `fewest` hits in `reach` characters: other hits cannot matter.
        first = np.flatnonzero(hit[self.fewest - 1:] - hit[:len(hit) - self.fewest + 1] < self.reach)
        edge = np.zeros(len(hit) + 1, np.int64)
        edge[first] = 1
        edge -= np.bincount(np.searchsorted(hit, hit[first] + self.reach), minlength=len(edge))
        at = hit[np.cumsum(edge[:-1]) > 0]
        if not len(at):
            return out
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        known = self.keys[key] == h[at]
        at, key = at[known], key[known]
        if not len(at):
            return out  # places that only may be known, such as a run of one word, or known to other windows
        many = self.many[key]
        entry = np.repeat(self.first[key] - np.cumsum(many) + many, many) + np.arange(many.sum())
        owner, place = self.owner[entry], self.place[entry]
        half = self.edits[owner] + 1
        band = (np.repeat(at, many) - place + self.reach) // half  # diagonals may be below 0
        # Each place of a window counts once in a band, however often its q-gram occurs there.
        shift, wide = int(band.max() + 2).bit_length(), int(self.size.max()).bit_length()
        cell = np.concatenate([owner << shift | band + 1, owner << shift | band])
        cell = _distinct(cell << wide | np.concatenate([place, place])) >> wide
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        cell, counts = cell[begin], np.diff(np.append(begin, len(cell)))
        done = {}
        for c in cell[counts >= self.least[cell >> shift]].tolist():
            w, b = c >> shift, (c & (1 << shift) - 1) - 1
            k = int(self.edits[w])
            lo = b * (k + 1) - self.reach
            found = align(self.codes[w], codes, lo - k, lo + 3 * k + 1, k, done.get(w))
            if found:
                out[w].append(found)
                done[w] = found
        return out


class Windows:
    """A block of benchmark windows, long and short."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW, error: float = ERROR):
        self.short, long, brief = [], ([], []), ([], [])
        for n, (item, text) in enumerate(items):
            codes, _ = normalize(text or "")
            codes = _stripped(codes)
            if not len(codes):
                continue
            if len(codes) < Q:
                self.short.append((n, codes))
                continue
            for (owners, parts), size, step in ((long, window, window // 2), (brief, SHORT, SHORT_STEP)):
                if size < window and len(codes) <= size:
                    continue  # the whole item is a long window
                starts = [0] if len(codes) <= size else sorted({*range(0, len(codes) - size, step), len(codes) - size})
                owners += [n] * len(starts)
                parts += [codes[s:s + size] for s in starts]
        self.ids = [item for item, _ in items]
        self.grams = [Grams(*long, error), Grams(*brief, min(error, SHORT_ERROR))]
        self.items = long[0] + brief[0]
        self.seen = np.zeros(1 << BITS, bool)
        for g in self.grams:
            self.seen[g.keys >> np.uint64(64 - BITS)] = True
        self.reach = max(g.reach for g in self.grams)

    def find(self, codes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Per window of the block: (start, stop, edits) of regions in the characters."""
        out = {}
        if not self.reach or len(codes) < Q:
            return out
        h = gram_hashes(codes)
        hit = np.flatnonzero(self.seen[h >> np.uint64(64 - BITS)])
        for g, before in zip(self.grams, (0, len(self.grams[0].items))):
            out |= {w + before: found for w, found in g.find(codes, h, hit).items()}
        return out

    def hits(self, text: str | None) -> list[dict]:
        """What the text holds of each item, in item order."""
        if not text:
            return []
        codes, where = normalize(text)
        return self.report(self._pieces(codes), codes, where)

    def _pieces(self, codes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        out = defaultdict(list)
        for lo in range(0, max(len(codes), 1), PIECE):
            for w, found in self.find(codes[max(0, lo - 2 * self.reach):lo + PIECE]).items():
                shift = max(0, lo - 2 * self.reach)
                out[w] += [(s + shift, e + shift, d) for s, e, d in found]
        return out

    def report(self, regions: dict[int, list[tuple[int, int, int]]], codes: np.ndarray, where: np.ndarray) -> list[dict]:
        by_item = defaultdict(list)
        for w, found in regions.items():
            by_item[self.items[w]].append((min(x[2] for x in found), min(x[0] for x in found), max(x[1] for x in found)))
        for n, short in self.short:
            s = _find(codes, short)
            if s >= 0:
                by_item[n].append((0, s, s + len(short)))
        return [{"item_id": self.ids[n], "n_windows": len(x), "edits": min(d for d, _, _ in x), "start": int(where[min(s for _, s, _ in x)]),
                 "stop": int(where[max(e for _, _, e in x) - 1]) + 1} for n, x in sorted(by_item.items())]

    def search(self, texts: pd.Series) -> list[list[dict]]:
        """`hits` of each text. Short texts are scanned together, with breaks between them."""
        out, group, size = [[] for _ in texts], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > PIECE:
                out[i] = self.hits(text)
                continue
            codes, where = normalize(text)
            group.append((i, codes, where))
            size += len(codes)
            if size > PIECE:
                self._group(group, out)
                group, size = [], 0
        self._group(group, out)
        return out

    def _group(self, group: list, out: list) -> None:
        if not group:
            return
        gap = np.full(2 * self.reach + 2, BREAK, np.uint32)
        joined = np.concatenate([x for _, codes, _ in group for x in (codes, gap)])
        begin = np.concatenate([[0], np.cumsum([len(codes) + len(gap) for _, codes, _ in group])])
        regions = defaultdict(lambda: defaultdict(list))
        for w, found in self.find(joined).items():
            for s, e, d in found:
                n = int(np.searchsorted(begin, s, side="right")) - 1
                regions[n][w].append((s - int(begin[n]), e - int(begin[n]), d))
        for n, (i, codes, where) in enumerate(group):
            if n in regions or self.short:
                out[i] = self.report(regions.get(n, {}), codes, where)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: np.unique hashes them first, which takes several times as long."""
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _stripped(codes: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(codes != 32)
    return codes[at[0]:at[-1] + 1] if len(at) else codes[:0]


def _find(codes: np.ndarray, part: np.ndarray) -> int:
    ok = np.ones(max(0, len(codes) - len(part) + 1), bool)
    for i, c in enumerate(part):
        ok &= codes[i:len(codes) - len(part) + 1 + i] == c
    at = np.flatnonzero(ok)
    return int(at[0]) if len(at) else -1


def align(part: np.ndarray, codes: np.ndarray, low: int, high: int, k: int, before: tuple[int, int, int] | None = None) -> tuple[int, int, int] | None:
    """The region that ends a path within diagonals low to high with the fewest edits, if at most k: (start, stop, edits).

    before: a region without edits found already; a band that holds it gives it again.
    """
    if before and before[2] == 0 and low <= before[0] <= high:
        return before
    m, n, width = len(part), len(codes), high - low + 1
    begin, stop = low, high + m
    text = np.full(stop - begin + 1, BREAK, np.uint32)
    a, b = max(begin, 0), min(stop + 1, n)
    if b > a:
        text[a - begin:b - begin] = codes[a:b]
    for d in np.flatnonzero(text[:width] == part[0]):  # an exact copy needs no table
        if 0 <= low + d <= n - m and np.array_equal(text[d:d + m], part):
            return int(low + d), int(low + d) + m, 0
    far = m + k + 1
    cell = np.arange(width)
    cost, start = np.zeros(width + 1, np.int64), np.append(low + cell, 0)  # any diagonal may be entered
    cost[width] = far
    for i in range(m):
        here = text[i:i + width]
        step = cost[:-1] + (here != part[i])
        step[here == BREAK] = far
        skip = cost[1:] + 1  # a character of the window is missing in the text
        take = skip < step
        best, origin = np.where(take, skip, step), np.where(take, start[1:], start[:-1])
        order = best - cell  # further characters of the text: the least of best[j] + (i - j) over j <= i
        least = np.minimum.accumulate(order)
        cost[:-1] = least + cell
        if cost.min() > k:
            return None
        start[:-1] = origin[np.maximum.accumulate(np.where(order == least, cell, 0))]
    end = int(cost.argmin())
    return (int(start[end]), m + low + end, int(cost[end])) if cost[end] <= k else None


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in blocks of about block_chars characters."""
    rows = benchmark.where("text is not null")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == b)
        yield sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def leaks(spark: SparkSession, text: Column, benchmark: DataFrame, window: int = WINDOW, error: float = ERROR) -> Column:
    """array of struct(item_id, n_windows, edits, start, stop): what the text holds of the benchmark."""
    found = [_search(spark.sparkContext.broadcast(block), window, error)(text) for block in blocks(benchmark)]
    return F.concat(*found) if len(found) > 1 else found[0]


def _search(shared, window: int, error: float):
    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Windows(shared.value, window, error)
        for texts in batches:
            yield pd.Series(index.search(texts), dtype=object)
    return search


def with_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """All rows and columns, with `leaks` (replaced if there)."""
    return docs.withColumn("leaks", leaks(spark, F.col(text_column), benchmark))


@query("op4_decontaminate")
def op4(spark: SparkSession, root: str) -> DataFrame:
    docs = with_leaks(spark, read(spark, root, "documents").select("doc_id", "text"), read(spark, root, "benchmark"))
    return docs.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
