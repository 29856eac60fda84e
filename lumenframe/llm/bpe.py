"""BPE encoding and decoding with a contiguous rank array.

A word is held as its part boundaries and, beside them, the merge rank of each part with the next. The
lowest rank is found by a scan, its boundary deleted, and the ranks of the two neighbours looked up anew.
Scans are cheap for short words; above `SHORT_WORD` parts the same merges come from a heap, so a word
of a million characters takes n log n steps. Words already seen are kept in a bounded table.

The vocabulary is a `tokenizer.json` of the byte-level kind. Its path is a parameter; the driver reads
the file (of at most `MAX_VOCABULARY` bytes) and sends it to the tasks as a broadcast.

Defined results: a null or empty text has no ids and decodes to an empty text; text equal to an added token
is that token, as in the library; a long text is split at safe places (before a blank between two other
characters), never cut short; ids are 32-bit little-endian numbers in one binary value.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, read

SHORT_WORD = 64
KEPT_BYTES = 40_000_000
# About what a table entry takes beside its characters.
ENTRY_BYTES = 190
PART_BYTES = 1 << 20
PIECE = 65_536
MAX_VOCABULARY = 64_000_000
# The split pattern of byte-level tokenizers, with white space spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# Characters that the regex module takes for letters or numbers and the tokenizers library does not.
_LATER = ("\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf"
          "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
          "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
          "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
          "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
          "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
          "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
EXACT_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_LATER}]]+| ?[\p{{N}}--[{_LATER}]]+| ?(?:[^{_SPACE}\p{{L}}\p{{N}}]|[{_LATER}])+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# The same pattern for texts of characters below 256, which the re module takes from a table.
_LETTER, _NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = r"\t-\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
ID_BITS = 32
MADE = (1 << ID_BITS) - 1
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Vocabulary(dict):
    """Maps a word to the bytes of its ids; words are encoded when first asked for."""

    def __init__(self, definition: bytes):
        super().__init__()
        self.held = 0
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or model.get("ignore_merges") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE without a normalizer or a prefix blank is supported")
        letters = byte_letters()
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.first = [model["vocab"][c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # By pair: the merge's rank and, in the low bits, the id it makes. Plain numbers compare faster than tuples.
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((model["vocab"][a], model["vocab"][b]), rank << ID_BITS | model["vocab"][a + b])
        self.added = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take white space or whole words are not supported")
            self.added[t["content"]] = t["id"]
            self.tokens[t["id"]] = t["content"].encode()
        self.words, self.exact_words = re.compile(LATIN_PATTERN), regex.compile(EXACT_PATTERN, regex.V1)
        self.cut = regex.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size = max(self.tokens) + 1
        self.lookup = [self.tokens.get(i, b"") for i in range(self.size)]
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.size, *model["vocab"].values()) + 1)]

    def __missing__(self, word: str) -> bytes:
        if self.held >= KEPT_BYTES:
            for old in list(itertools.islice(self, (len(self) + 1) // 2)):
                self.held -= len(old) + len(self.pop(old)) + ENTRY_BYTES
        ids = b"".join(map(self.packed.__getitem__, self.merge(list(map(self.first.__getitem__, word.encode())))))
        if len(word) <= SHORT_WORD:
            self[word] = ids
            self.held += len(word) + len(ids) + ENTRY_BYTES
        return ids

    def merge(self, parts: list[int]) -> list[int]:
        return self._scan(parts) if len(parts) <= SHORT_WORD else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        look = self.ranks.get
        found = list(map(look, zip(parts, parts[1:]), itertools.repeat(NEVER)))
        while found:
            best = min(found)
            if best == NEVER:
                break
            at = found.index(best)
            parts[at] = made = best & MADE
            del parts[at + 1], found[at]
            if at < len(found):
                found[at] = look((made, parts[at + 1]), NEVER)
            if at:
                found[at - 1] = look((parts[at - 1], made), NEVER)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (r := self.ranks.get((parts[i], parts[right[i]]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[right[i]]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = r & MADE, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > 2 * PIECE:
            found = self.cut.search(text, start + PIECE)
            if not found:
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:] if start else text

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text in which added tokens are ordinary text."""
        words = self.words if latin(text) else self.exact_words
        return b"".join(b"".join(map(self.__getitem__, words.findall(piece))) for piece in self.pieces(text))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.specials:
            return self.encode_plain(text)
        parts = self.specials.split(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if i % 2 else self.encode_plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes | None) -> str:
        lookup, known = self.lookup, np.frombuffer(ids or b"", "<u4")
        if len(known) and known.max() >= self.size:
            known = known[known < self.size]
        return b"".join(map(lookup.__getitem__, known.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(definition: bytes) -> Vocabulary:
    return Vocabulary(definition)


def load(spark: SparkSession, path: str):
    """The file's content as a broadcast."""
    with open(path, "rb") as f:
        definition = f.read(MAX_VOCABULARY + 1)
    if len(definition) > MAX_VOCABULARY:
        raise ValueError("the vocabulary file is too large to be sent to all tasks")
    Vocabulary(definition)
    return spark.sparkContext.broadcast(definition)


def encode(shared, text: Column) -> Column:
    """Ids as binary."""
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        v = vocabulary(shared.value)
        return texts.map(v.encode)
    return run(text)


def decode(shared, ids: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        v = vocabulary(shared.value)
        return values.map(v.decode)
    return run(ids)


def few(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of about `PART_BYTES`, or of one row."""
    lo, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if held > PART_BYTES:
            yield texts.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0
    if lo < len(texts):
        yield texts.slice(lo)


def round_trip(shared, text: Column, digest: bool = False) -> Column:
    """struct(ids, decoded): the text is encoded once, its ids decoded. With `digest` the decoded text stays in the worker,
    and `decoded` is the lowercase hex SHA-256 of its UTF-8 bytes."""
    @F.arrow_udf("ids binary, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(shared.value)
        shown = (lambda ids: hashlib.sha256(v.decode(ids).encode()).hexdigest()) if digest else v.decode
        for batch in batches:
            # Small parts: a worker holds one part's ids and texts beside the batch, whatever the batch's size.
            for texts in few(batch):
                ids = [v.encode(t.as_py()) for t in texts]
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(shown, ids), pa.string())], ["ids", "decoded"])
    return run(text)


def encode_rows(spark: SparkSession, docs: DataFrame, path: str, text_column: str = "text", digest: bool = False) -> DataFrame:
    """All rows and columns, with ids (binary), n_tokens and decoded, or decoded_sha256 with `digest`. Columns of these names are replaced."""
    both = docs.withColumn("_both", round_trip(load(spark, path), F.col(text_column), digest))
    return both.withColumns({"ids": F.col("_both.ids"), "n_tokens": (F.length("_both.ids") / 4).cast("bigint"),
                             "decoded_sha256" if digest else "decoded": F.col("_both.decoded")}).drop("_both")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_bpe")
def op9(spark: SparkSession, root: str) -> DataFrame:
    done = encode_rows(spark, read(spark, root, "documents").select("doc_id", "text"), default_vocabulary())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
