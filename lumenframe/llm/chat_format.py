"""Chat formatting by token-level assembly.

Each turn is encoded by itself: the text of role and content by the BPE, the marks by reserved ids above the
vocabulary, spliced between. So content can never become a mark. The formatted text shows the same marks as
control strings; where content holds one of them, or one already escaped, a backslash is put after its first
character, which is undone by taking one away. The loss mask of a turn comes from the prefix sum of +1 where
a trained segment starts and -1 where it ends.

A turn is one row: encoding and masks need no other turn, and a conversation of any length is its rows in
turn order. Only the digests, which are sequential by nature, read the rows of a conversation in order; they do so
as a stream over partitions dealt by conversation and sorted, holding one turn at a time.

Template: <s> at a conversation's first turn, then per turn <|turn|> role <|text|> content <|end|>.

Defined results: null role or text is empty; equal turns of a conversation are ordered by role, then text, and rows that
are equal in all stay all; null conversations form one, null turns come first; extra columns stay, the output
columns are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, load, vocabulary
from .registry import query, read

# The marks of this template, then control strings of other templates that are escaped as well.
START, TURN, TEXT, END = "<s>", "<|turn|>", "<|text|>", "<|end|>"
MARKS = [START, TURN, TEXT, END]
FOREIGN = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
TRAINED = "assistant"
_CONTROL = sorted([*MARKS, *FOREIGN], key=len, reverse=True)
_PLAIN = regex.compile("|".join(regex.escape(c[0]) + r"(\\*)" + regex.escape(c[1:]) for c in _CONTROL))
_ESCAPED = regex.compile("|".join(regex.escape(c[0]) + r"\\(\\*)" + regex.escape(c[1:]) for c in _CONTROL))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def assemble(v, role: str, text: str, first: bool, trained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of a turn."""
    base = v.size
    start, turn, body, end = ([base + i] for i in range(4))
    of = lambda s: np.frombuffer(v.encode_plain(escape(s)), "<u4")
    content = of(text)
    head = np.concatenate([start if first else [], turn, of(role), body]).astype(np.uint32)
    ids = np.concatenate([head, content, end]).astype(np.uint32)
    edge = np.zeros(len(ids) + 1, np.int8)
    if trained:
        edge[len(head)] += 1
        edge[len(head) + len(content)] -= 1
    return ids, np.cumsum(edge[:-1]).astype(np.int8)


def _spliced(v, ids: np.ndarray) -> str:
    """The formatted text of ids, with marks as control strings."""
    out, base = [], v.size
    at = np.flatnonzero(ids >= base)
    last = 0
    for i in at.tolist():
        out += [v.decode(ids[last:i].tobytes()), MARKS[int(ids[i]) - base]]
        last = i + 1
    return "".join([*out, v.decode(ids[last:].tobytes())])


def read_turn(v, ids: np.ndarray) -> tuple[str, str]:
    """Role and text of a turn's ids."""
    base = v.size
    turn, body, end = (int(np.flatnonzero(ids == base + i)[0]) for i in (1, 2, 3))
    return tuple(unescape(v.decode(ids[a + 1:b].astype("<u4").tobytes())) for a, b in ((turn, body), (body, end)))


def format_turns(spark: SparkSession, turns: DataFrame, path: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """All rows and columns, with is_first, formatted (text), ids (32-bit, binary) and mask (one byte per id, binary)."""
    shared = load(spark, path)

    @F.pandas_udf("formatted string, ids binary, mask binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        v = vocabulary(shared.value)
        for roles, texts, firsts in batches:
            out = []
            for r, t, f in zip(roles, texts, firsts):
                ids, mask = assemble(v, r, t, bool(f), r == TRAINED)
                out.append((_spliced(v, ids), ids.tobytes(), mask.tobytes()))
            yield pd.DataFrame(out, columns=["formatted", "ids", "mask"])

    # The first turn: the least (turn, role, text) of its conversation, aggregated before it is joined back. Equal
    # rows are told apart by nothing, so the first of them is marked by its number among them.
    key = F.struct(F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    keyed = turns.withColumn("_key", key)
    least = keyed.groupBy(F.col(conversation).alias("_conv")).agg(F.min("_key").alias("_least"))
    joined = keyed.join(least, F.col(conversation).eqNullSafe(F.col("_conv")))
    is_first = F.col("_key").eqNullSafe(F.col("_least"))
    done = joined.withColumn("is_first", is_first).withColumn("_out", run(F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")), is_first))
    return done.withColumns({c: F.col(f"_out.{c}") for c in ("formatted", "ids", "mask")}).drop("_conv", "_least", "_key", "_out")


class _Digest:
    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, v, formatted: str, ids: np.ndarray, mask: np.ndarray) -> None:
        role, text = read_turn(v, ids)
        loss = unescape(v.decode(ids[mask == 1].astype("<u4").tobytes()))
        self.turns += 1
        self.text.update(f"{role}\n{text}\n".encode())
        self.loss_chars += len(loss)
        self.loss.update(loss.encode())
        self.chars += len(formatted)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(spark: SparkSession, formatted: DataFrame, path: str) -> DataFrame:
    """One row per conversation, read back from ids and masks."""
    shared = load(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        now, state, out = None, None, []

        def row() -> list:
            return [now[0], state.turns, state.text.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars]

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in DIGEST.split(", ")])

        for rows in batches:
            for conv, text, ids, mask in zip(*(rows.column(c) for c in ("conv_id", "formatted", "ids", "mask"))):
                if now is None or now[0] != conv.as_py():
                    if now is not None:
                        out.append(row())
                    now, state = (conv.as_py(),), _Digest()
                state.add(v, text.as_py(), np.frombuffer(ids.as_py(), "<u4"), np.frombuffer(mask.as_py(), np.int8))
            if out:
                yield batch()
                out = []
        if now is not None:
            out.append(row())
            yield batch()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "formatted", "ids", "mask")
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "text")
    return ordered.select("conv_id", "formatted", "ids", "mask").mapInArrow(run, DIGEST)


@query("op8_chat_format", r"""
WITH given AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given),
shown AS (
    SELECT *, length(regexp_replace(role || chr(0) || text,
        '(<(?:\\*)(?:s>|/s>|\|turn\|>|\|text\|>|\|end\|>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)|\[(?:\\*)(?:INST\]|/INST\]))', '\1.', 'g')) - 1
        + length('<|turn|><|text|><|end|>') AS size
    FROM clean)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(size) + length('<s>') AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
""")
def op8(spark: SparkSession, root: str) -> DataFrame:
    given = read(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    path = default_vocabulary()
    return digests(spark, format_turns(spark, given.unionByName(control), path), path)
