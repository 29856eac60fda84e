"""Secret scans with a trigram index, in DataFrame functions only.

From each rule's expression a Boolean query of trigrams is derived: what every match must contain in lower case.
An inverted index lists the documents of each trigram that occurs in a query; the lists are intersected
and united per rule, and only the documents that are left are matched against that rule. Rules without mandatory
trigrams (a run of hexadecimal digits) are matched against every document. A rule's matches are leftmost
and do not overlap; a match whose value is too short is dropped after matching. Places count code points and
come from running sums over a document's gaps and matches.

Rules are Java expressions in the common syntax that Python's parser reads too; no group but the value's.

Defined results: null or empty texts have no spans; extra columns stay, `spans` is replaced if there; rows with equal
ids are told apart by their texts; null ids are kept. A document's own matches are ordered in one task; nothing
else is gathered by document.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, read

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, then further well-known forms.
RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_host", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]
BASE = ("assign", "access", "hex")

# A query is True, a trigram, or ("and" | "or", parts).


def _both(kind: str, parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not True)) if kind == "and" else list(dict.fromkeys(parts))
    if kind == "or" and (True in parts or not parts):
        return True
    if not parts:
        return True
    if kind == "or":  # what asks for more than another part asks for adds nothing
        plain = {p: {p} if isinstance(p, str) else set(p[1]) for p in parts if isinstance(p, str) or (p[0] == "and" and all(isinstance(x, str) for x in p[1]))}
        parts = [p for p in parts if not any(q != p and plain[q] < plain[p] for q in plain if p in plain)]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]):
    return _both("or", [_both("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _analyze(items) -> tuple[set[str] | None, object]:
    """The exact strings of a sequence if they are few, and the query that its matches meet."""
    run, parts, exact = {""}, [], True
    for op, value in items:
        strings, need = _item(op, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in itertools.product(run, strings)}
            continue
        exact = False
        parts += [_of_strings(run), need if strings is None else _of_strings(strings)]
        run = {""}
    return (run, True) if exact else (None, _both("and", [*parts, _of_strings(run)]))


def _item(op, value) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, True
    if op is sre.IN:
        letters = {chr(v).lower() for o, v in value if o is sre.LITERAL}
        return (letters, True) if len(letters) <= 5 and all(o is sre.LITERAL for o, _ in value) else (None, True)
    if op is sre.SUBPATTERN:
        return _analyze(value[-1])
    if op is sre.BRANCH:
        found = [_analyze(x) for x in value[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), True
        return None, _both("or", [need if s is None else _of_strings(s) for s, need in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = value
        strings, need = _analyze(inner)
        if strings is not None and (low, high) == (1, 1):
            return strings, True
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, True
        if low == 0:
            return None, True
        return None, need if strings is None else _of_strings({s * low if len(strings) == 1 and low < 9 else s for s in strings})
    return None, True


def trigram_query(pattern: str):
    """What every match of the expression contains, in lower case."""
    strings, need = _analyze(sre_parser.parse(pattern))
    return need if strings is None else _of_strings(strings)


def trigrams(need) -> set[str]:
    return set() if need is True else {need} if isinstance(need, str) else set().union(*map(trigrams, need[1]))


def _holds(found: Column, need) -> Column:
    if isinstance(need, str):
        return F.array_contains(found, need)
    parts = [_holds(found, p) for p in need[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if need[0] == "and" else out | p
    return out


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """The inverted index: one row (trigram, id) per trigram of the rules' queries in a document."""
    low = docs.select("id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(w), F.lit(w)) for w in words]))
    return low.select("id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """id, rules: the rules with trigrams whose queries a document meets."""
    needs = {r.kind: trigram_query(r.pattern) for r in rules}
    needs = {k: n for k, n in needs.items() if n is not True}
    if not needs:
        return None
    lists = postings(docs, sorted(set().union(*map(trigrams, needs.values()))))
    # A document has at most as many rows as there are trigrams in the queries.
    met = lists.groupBy("id").agg(F.collect_set("trigram").alias("found"))
    kinds = F.array_compact(F.array(*[F.when(_holds(F.col("found"), n), F.lit(k)) for k, n in needs.items()]))
    return met.select("id", kinds.alias("rules")).where(F.size("rules") > 0)


def _matches(text: Column, number: int, rule: Rule) -> Column:
    """array of struct(kind, place, gap before, length, is it kept)."""
    hits, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(hits.alias("hit"), values.alias("value"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    return F.transform(zipped, lambda x, i: F.struct(
        F.lit(number).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["value"]) >= rule.least).alias("kept")))


MATCHES = "array<struct<kind:int,place:int,gap:int,size:int,kept:boolean>>"


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """All rows and columns, with spans: array of struct(start, kind number, stop, kind) in that order."""
    slim = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    possible = candidates(slim, rules)
    free = [r.kind for r in rules if trigram_query(r.pattern) is True]
    if possible is not None:
        joined = slim.join(possible.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left")
    else:
        joined = slim.withColumn("rules", F.lit(None).cast("array<string>"))
    empty = F.array().cast(MATCHES)
    found = F.concat(*[_matches(F.col("text"), n, r).cast(MATCHES) if r.kind in free else F.when(F.array_contains("rules", r.kind), _matches(F.col("text"), n, r).cast(MATCHES)).otherwise(empty)
                       for n, r in enumerate(rules)])
    rows = joined.select("id", F.xxhash64("text").alias("print"), F.explode(found).alias("m")).select("id", "print", "m.*").distinct()
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("id", "print", "kind").orderBy("place"))
    placed = rows.withColumn("stop", upto).where("kept").withColumn("start", F.col("stop") - F.col("size"))
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = placed.groupBy("id", "print").agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("number"), "stop", F.element_at(names, F.col("kind") + 1).alias("kind")))).alias("spans"))
    spans = spans.select(F.col("id").alias("_id"), F.col("print").alias("_print"), F.col("spans").alias("_spans"))
    marked = docs.withColumn("_of", F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))).join(
        spans, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_print")), "left")
    kind = "array<struct<start:bigint,number:int,stop:bigint,kind:string>>"
    return marked.withColumn("spans", F.coalesce(F.col("_spans"), F.array().cast(kind))).drop("_of", "_id", "_print", "_spans")


def digest_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _oracle() -> str:
    parts = []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {n} AS number, '{r.kind}' AS kind, generate_subscripts(h, 1) AS pos, length(unnest(h)) AS size, length(unnest(g)) AS gap, length(unnest(v)) >= {r.least} AS kept
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}')[:-2] AS g FROM docs)""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, number ORDER BY pos) AS stop FROM found),
spans AS (SELECT doc_id, number, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE kept)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (WHERE kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number), '') AS spans
FROM docs d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id"""


@query("op6_secret_scan", _oracle())
def op6(spark: SparkSession, root: str) -> DataFrame:
    done = scan_secrets(read(spark, root, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return done.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest_text(base).cast("binary"), 256).alias("base_sha256"), digest_text(F.col("spans")).alias("spans"))
