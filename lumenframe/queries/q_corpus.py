"""Snippet corpus building. Source files are made from `documents` by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import corpus as c
from ..session import scratch_dir, table
from ..sources.files import scan_sources
from .registry import query

# Files of documents: by number whole, in two blocks, or with a marker fault.
FILES_SQL = r"""
SELECT doc_id, text AS body, CASE doc_id % 4 WHEN 0 THEN source || '/' || lang || '/doc_' || doc_id || '.py' WHEN 1 THEN source || '/doc-' || doc_id || '.md'
    WHEN 2 THEN 'doc' || doc_id || '.SQL' ELSE source || '/' || lang || '/deep/notes' || doc_id END AS path,
  CASE WHEN doc_id % 5 = 0 THEN 'whole' WHEN doc_id % 7 <> 0 THEN 'marked' ELSE ['nested', 'mismatch', 'unclosed', 'stray'][doc_id % 4 + 1] END AS kind,
  len(string_split(text, chr(10))) AS n FROM documents"""


def _files(spark, root):
    d = table(spark, root, "documents", "doc_id")
    i = F.col("doc_id")
    name = i.cast("string")
    path = (F.when(i % 4 == 0, F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), name, F.lit(".py")))
            .when(i % 4 == 1, F.concat("source", F.lit("/doc-"), name, F.lit(".md")))
            .when(i % 4 == 2, F.concat(F.lit("doc"), name, F.lit(".SQL")))
            .otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/deep/notes"), name)))
    opened = F.concat(F.lit("first\n# --8<-- [start:setup]\n"), "text", F.lit("\n"))
    second = F.concat(F.lit("between\n# --8<- [start:df_"), name, F.lit("]\nimport x\nprint(x)\n# --8<- [end:df_"), name, F.lit("]\n"))
    good = F.concat(opened, F.lit("# --8<-- [end:setup]\n"), second)
    bad = (F.when(i % 4 == 0, F.concat(opened, second)).when(i % 4 == 1, F.concat(opened, F.lit("# --8<-- [end:other]\n"), second))
           .when(i % 4 == 2, opened).otherwise(F.concat(F.lit("# --8<-- [end:setup]\n"), good)))
    text = F.when(i % 5 == 0, F.col("text")).when(i % 7 != 0, good).otherwise(bad)
    return d.select(path.alias("path"), text.alias("text"))


@query("corpus_scan", """
SELECT 'a bucket=' || (number % 4) || '/part' AS path, sha1(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS sha1 FROM (
  SELECT doc_id // 50 AS number, doc_id, text FROM documents) GROUP BY number""")
def corpus_scan(spark, root):
    # Source files of at most 50 documents each, in four folders below a root with a blank and a percent sign.
    number = F.floor(F.col("doc_id") / 50)
    d = table(spark, root, "documents", "doc_id").groupBy(number.alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("l"))
    folder = scratch_dir(spark, "source tree 5%")
    made = d.select((F.col("number") % 4).alias("a bucket"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("value"))
    made.write.option("maxRecordsPerFile", 1).partitionBy("a bucket").text(folder)
    found = scan_sources(spark, folder)
    # The writer's own part of a file name is left out of the comparison.
    return found.select(F.regexp_replace("path", "/part-[^/]*$", "/part").alias("path"), F.sha1(F.encode("text", "UTF-8")).alias("sha1"))


BLOCKS_SQL = f"""
WITH f AS ({FILES_SQL}), blocks AS (
SELECT path, 1 AS ordinal, 'file' AS name, 0 AS marker_start_line, 1 AS content_start_line,
  CAST(CASE WHEN body = '' THEN 0 WHEN suffix(body, chr(10)) THEN n - 1 ELSE n END AS INTEGER) AS content_end_line, 0 AS marker_end_line, body AS code
FROM f WHERE kind = 'whole'
UNION ALL SELECT path, 1, 'setup', 2, 3, CAST(n + 2 AS INTEGER), CAST(n + 3 AS INTEGER), body || chr(10) FROM f WHERE kind = 'marked'
UNION ALL SELECT path, 2, 'df_' || doc_id, CAST(n + 5 AS INTEGER), CAST(n + 6 AS INTEGER), CAST(n + 7 AS INTEGER), CAST(n + 8 AS INTEGER),
  'import x' || chr(10) || 'print(x)' || chr(10) FROM f WHERE kind = 'marked')"""


@query("segment_markers", f"{BLOCKS_SQL} SELECT * FROM blocks WHERE marker_start_line > 0")
def segment_markers(spark, root):
    return c.segments(_files(spark, root)).where("marker_start_line > 0")


@query("segment_whole_file", f"{BLOCKS_SQL} SELECT path, name, content_end_line, code FROM blocks WHERE marker_start_line = 0")
def segment_whole_file(spark, root):
    return c.segments(_files(spark, root)).where("marker_start_line = 0").select("path", "name", "content_end_line", "code")


@query("segment_violations", f"""
WITH f AS ({FILES_SQL}) SELECT path, CAST(CASE kind WHEN 'nested' THEN n + 4 WHEN 'mismatch' THEN n + 3 WHEN 'unclosed' THEN n + 2 ELSE 1 END AS BIGINT) AS line,
  CASE kind WHEN 'nested' THEN 'nested start' WHEN 'mismatch' THEN 'mismatched end: expected setup, got other'
    WHEN 'unclosed' THEN 'unclosed setup' ELSE 'unexpected end' END AS fault
FROM f WHERE kind NOT IN ('whole', 'marked')""")
def segment_violations(spark, root):
    return c.violations(_files(spark, root))


PAGE_PATH = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def _page_path():
    return F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")


@query("path_parts", rf"""
SELECT page_id, CASE WHEN len(p) > 1 THEN p[1] ELSE 'root' END AS category, CASE WHEN len(p) > 2 THEN p[2:-2] ELSE [] END AS subcategories,
  regexp_replace(p[-1], '(.)\.[^.]+$', '\1') AS file_stem FROM (SELECT page_id, string_split({PAGE_PATH}, '/') AS p FROM pages)""")
def path_parts(spark, root):
    return table(spark, root, "pages").select("page_id", c.path_parts(_page_path()).alias("p")).select("page_id", "p.*")


@query("detect_language", f"""
SELECT page_id, CASE WHEN suffix({PAGE_PATH}, '/') THEN 'text' ELSE ['python', 'markdown', 'yaml', 'rs', 'text'][page_id % 5 + 1] END AS language FROM pages""")
def detect_language(spark, root):
    ends = F.array(*[F.lit(e) for e in (".py", ".MD", ".yml", ".rs", "")])
    path = F.concat(F.replace(_page_path(), F.lit("."), F.lit("_")), F.get(ends, (F.col("page_id") % 5).cast("int")))
    return table(spark, root, "pages").select("page_id", c.language(path).alias("language"))


@query("classify_role", """
SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN 'file' WHEN 1 THEN 'setup' WHEN 2 THEN 'setup' WHEN 3 THEN 'data' WHEN 4 THEN 'data' ELSE 'example' END AS kind
FROM conversations""")
def classify_role(spark, root):
    stems = F.array(*[F.lit(x) for x in ("File", "context", "prepare_", "df", "props_", "dfx", "")])
    k = (F.col("turn") % 7).cast("int")
    own = F.when(k.isin(2, 4, 6), F.col("role")).when(k == 3, (F.col("turn") % 10).cast("string")).otherwise("")
    return table(spark, root, "conversations").select("conv_id", "turn", c.role(F.concat(F.get(stems, k), own)).alias("kind"))


# Tags that fit the invented prose of the test texts.
PROSE = [
    c.Tag("article", r"\bthe\b|\bdie\b", "articles"), c.Tag("number", r"[0-9]+", "numbers"), c.Tag("mail", r"[a-z]@[a-z]", "mail addresses"),
    c.Tag("code", r"def |import ", "code words"), c.Tag("plural", r"\bles\b|\bdes\b", "plural articles"), c.Tag("license", r"licen[sc]e", "license_text"),
]
EDGE = lambda w: rf"(^|[^\pL\pM\pN_]){w}($|[^\pL\pM\pN_])"
PROSE_SQL = [
    ("article", f"{EDGE('the')}|{EDGE('die')}"), ("number", "[0-9]+"), ("mail", "[a-z]@[a-z]"), ("code", "def |import "),
    ("plural", f"{EDGE('les')}|{EDGE('des')}"), ("license", "licen[sc]e"),
]
HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in PROSE_SQL) + "], lambda x: x IS NOT NULL)"


@query("detect_operations", f"SELECT doc_id, {HITS} AS operations FROM documents")
def detect_operations(spark, root):
    return table(spark, root, "documents", "doc_id").select("doc_id", c.operations(F.col("text"), PROSE).alias("operations"))


@query("tag_labels_purpose", f"""
WITH d AS (SELECT doc_id, ['setup', 'data', 'file', 'example'][doc_id % 4 + 1] AS kind, source || ' / ' || lang AS about, {HITS}[1] AS op FROM documents),
l AS (SELECT *, CASE op WHEN 'article' THEN 'articles' WHEN 'number' THEN 'numbers' WHEN 'mail' THEN 'mail addresses' WHEN 'code' THEN 'code words'
  WHEN 'plural' THEN 'plural articles' WHEN 'license' THEN 'license_text' END AS label FROM d)
SELECT doc_id, label, CASE kind WHEN 'setup' THEN 'Setup code for the ' || about || ' snippets.'
  WHEN 'data' THEN CASE WHEN op IS NULL THEN 'Builds example input data for the ' || about || ' snippets.' ELSE 'Builds example input data for ' || label || ' in ' || about || '.' END
  WHEN 'file' THEN 'Full source file from ' || about || ' when no explicit snippet markers are available.'
  ELSE CASE WHEN op IS NULL THEN 'Example snippet from ' || about || '.' ELSE 'Demonstrates ' || label || ' in ' || about || '.' END END AS purpose,
  CASE WHEN kind IN ('setup', 'file') THEN 'Topic ' || kind ELSE 'Topic: ' || kind END AS title FROM l""")
def tag_labels_purpose(spark, root):
    kinds = F.array(*[F.lit(k) for k in ("setup", "data", "file", "example")])
    d = table(spark, root, "documents", "doc_id").select(
        "doc_id", F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("kind"), F.concat("source", F.lit(" / "), "lang").alias("about"),
        F.get(c.operations(F.col("text"), PROSE), F.lit(0)).alias("op"))
    return d.select("doc_id", c.tag_label(F.col("op"), PROSE).alias("label"),
                    c.purpose(F.col("kind"), F.col("about"), F.col("op"), PROSE).alias("purpose"),
                    c.title(F.lit("Topic"), F.col("kind")).alias("title"))


@query("tags_ordered_unique", """
SELECT p_partkey, list_filter(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN list_position(v, v[i]) = i AND v[i] <> '' THEN v[i] END), lambda x: x IS NOT NULL) AS tags
FROM (SELECT p_partkey, [p_type, split_part(p_name, ' ', 1), '', split_part(p_name, ' ', 2), lower(p_type)] AS v FROM part)""")
def tags_ordered_unique(spark, root):
    w = F.split("p_name", " ")
    v = F.array("p_type", F.get(w, F.lit(0)), F.lit(""), F.get(w, F.lit(1)), F.lower("p_type"))
    return table(spark, root, "part").select("p_partkey", c.ordered_unique(v).alias("tags"))


STATS = r"""CAST(CASE WHEN {0} = '' THEN 0 ELSE len(string_split(regexp_replace({0}, '\r?\n\z', ''), chr(10))) END AS INTEGER) AS line_count,
  CAST(length({0}) AS INTEGER) AS char_count, contains({0}, 'import ') AS has_import, contains({0}, 'print(') AS has_print,
  contains({0}, 'np.') OR contains({0}, 'import numpy') AS has_library, regexp_full_match({0}, '[\s\p{{Z}}]*') AS is_empty"""


@query("snippet_stats", f"SELECT doc_id, {STATS.format('text')} FROM documents")
def snippet_stats(spark, root):
    return table(spark, root, "documents", "doc_id").select("doc_id", c.stats(F.col("text"), "numpy", "np").alias("s")).select("doc_id", "s.*")


@query("content_sha1", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def content_sha1(spark, root):
    return table(spark, root, "documents", "doc_id").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("sha1"))


def _records(spark, root):
    return c.records(c.segments(_files(spark, root)), "corpus", "numpy", "np", PROSE)


PARTS = r"""
SELECT *, CASE WHEN len(p) > 1 THEN p[1] ELSE 'root' END AS category, CASE WHEN len(p) > 2 THEN p[2:-2] ELSE [] END AS subs,
  regexp_replace(p[-1], '\.[A-Za-z]+$', '') AS stem,
  CASE WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.md') THEN 'markdown' WHEN suffix(path, '.SQL') THEN 'sql' ELSE 'text' END AS language,
  CASE WHEN name = 'file' THEN 'file' WHEN name = 'setup' THEN 'setup' ELSE 'data' END AS role FROM (
    SELECT *, string_split(path, '/') AS p, {hits} AS ops FROM (SELECT *, code AS text FROM blocks))"""
TITLE = "array_to_string(list_transform(string_split(replace(replace({0}, '_', ' '), '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("snippet_record", f"""{BLOCKS_SQL}, r AS ({PARTS.format(hits=HITS)})
SELECT path || '#' || name AS id, language, category, subs AS subcategories, name AS snippet_name, ordinal AS snippet_ordinal, sha1(code) AS sha1, role,
  {TITLE.format('category')} || CASE WHEN len(subs) > 0 THEN ' / ' || array_to_string(list_transform(subs, lambda x: upper(x[1]) || lower(x[2:])), ' / ') ELSE '' END
    || ' / ' || {TITLE.format('stem')} AS context_label,
  {TITLE.format('stem')} || CASE WHEN name IN ('file', 'setup') THEN ' ' ELSE ': ' END || {TITLE.format('name')} AS title, ops AS operations, ops[1] AS primary_operation,
  list_filter(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN list_position(v, v[i]) = i AND v[i] <> '' THEN v[i] END), lambda x: x IS NOT NULL) AS tags,
  {STATS.format('code')}, row_number() OVER (ORDER BY path, content_start_line, ordinal) AS place
FROM (SELECT *, list_concat([category], subs, [stem, name, role, language], ops) AS v FROM r)""")
def snippet_record(spark, root):
    recs = _records(spark, root)
    folder = c.write_corpus(recs, scratch_dir(spark, "corpus"), "corpus")
    return c.read_corpus(spark, folder, recs.schema).select(
        "id", "language", "source.category", "source.subcategories", "source.snippet_name", "source.snippet_ordinal", "source.sha1",
        "metadata.snippet.role", "metadata.path.context_label", "metadata.snippet.title", "metadata.inferred.operations",
        "metadata.inferred.primary_operation", "metadata.inferred.tags", "stats.*", "place")


@query("corpus_head", f"""{BLOCKS_SQL}, k AS (SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS category FROM blocks),
n AS (SELECT category, count(*) AS n FROM k GROUP BY 1)
SELECT CAST(1 AS INTEGER) AS schema_version, 'corpus' AS source_root, (SELECT count(DISTINCT path) FROM k) AS file_count, (SELECT count(*) FROM k) AS snippet_count,
  (SELECT string_agg(category || '=' || n, ';' ORDER BY category) FROM n) AS categories""")
def corpus_head(spark, root):
    folder = c.write_corpus(_records(spark, root), scratch_dir(spark, "corpus"), "corpus")
    entries = F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return c.read_head(spark, folder).withColumn("categories", F.array_join(entries, ";"))


@query("corpus_summary", f"""{BLOCKS_SQL}, k AS (SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS category FROM blocks)
SELECT category, count(DISTINCT path) AS files, count(*) AS snippets FROM k GROUP BY 1
UNION ALL SELECT NULL, count(DISTINCT path), count(*) FROM k""")
def corpus_summary(spark, root):
    return c.summary(_records(spark, root))
