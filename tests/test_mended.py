"""Faults found in review: long blanks, deep content, odd paths, hot keys, folder streams."""

import json
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenframe.functions.text import is_blank, strip
from lumenframe.operators import aggregates, joins, ordering
from lumenframe.plans import pairs, scores, training_sets
from lumenframe.sources.files import relative_path, scan_sources
from lumenframe.streaming.bounded import run_once


def test_strip_is_linear_and_takes_all_white_space(spark):
    text = "\x1c\x1f \u3000a" + " " * 1_000_000 + "b\x85\n"
    df = spark.createDataFrame([(text,), (" \x1d\u2028 ",)], "t string").coalesce(1)
    df.count()
    start = time.time()
    assert [r[0] for r in df.select(F.char_length(strip(F.col("t")))).collect()] == [1_000_002, 0]
    assert time.time() - start < 5 and df.where(is_blank(F.col("t"))).count() == 1


def deep(n, inner):
    for _ in range(n):
        inner = {"content": inner}
    return inner


def test_content_of_any_depth(spark):
    values = ["a", {"text": "b"}, deep(40, "c"), deep(3, {"text": deep(5, "d")}), ["x", {"type": "text", "text": "y"}, deep(9, ["p", "q"]), deep(2, ""), 5], None, 7, deep(6, None)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    got = [r[0] for r in df.orderBy("i").select(training_sets.content_to_text(F.parse_json("j"))).collect()]
    assert got == ["a", "b", "c", "d", "x\ny\np\nq", "", "7", ""]


def test_chats_and_completions_of_all_shapes(spark):
    chat = [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": deep(5, "<answer>no</answer>")}, {"role": "user", "content": None}]
    df = spark.createDataFrame([(json.dumps(chat),)], "j string").select(F.parse_json("j").alias("messages"))
    made = df.select(training_sets.chat_column(df, "messages").alias("m")).select("m", training_sets.history_error(F.col("m")).alias("e")).first()
    assert [tuple(x) for x in made["m"]] == [("user", "q"), ("assistant", "<answer>no</answer>"), ("user", "")] and made["e"].startswith("thoughts")
    shapes = ["<answer>4</answer>", {"role": "assistant", "content": "<answer>4</answer>"}, ["", {"content": deep(4, {"text": "<answer>4</answer>"})}], [["<answer>4</answer>"]]]
    df = spark.createDataFrame([(json.dumps(s), json.dumps({"text": " 4 "})) for s in shapes], "c string, g string").select(F.parse_json("c").alias("c"), F.parse_json("g").alias("g"))
    assert {r["exact"] for r in scores.score_table(df, "c", "g").collect()} == {2.0}


@pytest.mark.parametrize("said, bad", [("[]", False), ("{}", False), ("0", False), ('""', False), ("false", False), ("null", False), ('["e"]', True), ('"e"', True), ('{"a":1}', True), ("3", True)])
def test_any_value_is_a_contract_error(spark, said, bad):
    df = spark.range(1).select(F.parse_json(F.lit('{"validation":{"contract_errors":' + said + "}}")).alias("v"))
    assert df.select(pairs.has_contract_errors(F.col("v"))).first()[0] is bad


def test_paths_with_odd_characters(spark, tmp_path):
    root = tmp_path / "my src+%20"
    for name in ("a b/y z.py", "50%/c#d+e.py", str(root).lstrip("/") + "/x.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    got = {r["path"]: r["text"] for r in scan_sources(spark, str(root)).collect()}
    assert len(got) == 3 and all(k == v for k, v in got.items())
    with pytest.raises(PySparkException):
        spark.range(1).select(relative_path(spark, str(root), F.lit("file:/elsewhere/x"))).collect()


def test_pair_cuts_stay_within_the_number_of_parts(spark):
    df = spark.range(40_000).select((F.col("id") % 40).alias("v"), F.col("id").alias("t"))
    for descending in (False, True):
        b = ordering.with_order_bucket(df, "v", "t", parts=200, descending=descending)
        sizes = [r["count"] for r in b.groupBy(ordering.BUCKET).count().collect()]
        assert len(sizes) <= 200 and max(sizes) < 1000
        rows = b.select("v", "t", ordering.BUCKET).collect()
        order = sorted(rows, key=lambda r: (-r["v"] if descending else r["v"], r["t"]))
        assert [r[ordering.BUCKET] for r in order] == sorted(r[ordering.BUCKET] for r in rows)


def test_order_buckets_with_nulls_and_texts(spark):
    rows = [(None if i % 3 == 0 else "x" * 100 + str(i % 7), None if i % 11 == 0 else i) for i in range(4000)]
    df = spark.createDataFrame(rows, "v string, t long")
    got = [(r["v"], r["t"]) for r in ordering.number_rows(df, "n", "v", "t", parts=30).orderBy("n").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0))


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_with_a_hot_key(spark, how):
    a = spark.createDataFrame([(1, 0), (2, 1), (None, 2)] + [(9, i) for i in range(5)], "k int, a int")
    b = spark.createDataFrame([(9, i) for i in range(50)] + [(3, 7), (None, 8)], "k int, b int")
    key = lambda df: sorted(map(str, df.select("k", "a", "b").collect()))
    made = joins.outer_join(a, b, "k", how)
    assert key(made) == key(a.join(b, "k", how)) and "FullOuter" not in made._jdf.queryExecution().executedPlan().toString()


def test_range_join_of_long_and_endless_spans(spark):
    points = [(i, float(x)) for i, x in enumerate([-1e15, -3, 0, 0.5, 1, 7, 1e6, 1e12, 1e15])]
    inf = float("inf")
    spans = [(1, 0.0, 1e12), (2, -inf, inf), (3, 5.0, inf), (4, -inf, 0.0), (5, 0.0, 1.0), (6, 6.5, 7.0), (7, 3.0, 2.0), (8, 0.25, 1e6)]
    got = joins.range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "s int, lo double, hi double"), "x", "lo", "hi", width=1.0)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((p, s) for p, x in points for s, lo, hi in spans if lo < x <= hi)


def test_streams_read_folders_and_nothing(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t.parquet"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    schema = spark.range(1).schema
    assert run_once(spark, str(tmp_path / "t.parquet"), schema, count, []).first()["n"] == 10
    (tmp_path / "none").mkdir()
    assert run_once(spark, str(tmp_path / "none"), schema, count, []).first()["n"] == 0


def test_lists_in_both_forms(spark):
    df = spark.createDataFrame([("a", 3, None), ("a", 1, "x"), ("b", None, "z"), ("a", None, "y")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in aggregates.collect_lists(df, ["k"], "v", "o").collect()} == {"a": ["x", None, "y"], "b": ["z"]}
    assert sorted((r["k"], r["position"], r["v"]) for r in aggregates.list_positions(df, ["k"], "o").where("v is not null").collect()) == [("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z")]


def test_stream_batches_write_only_the_groups_they_touch(spark, tmp_path, monkeypatch):
    from lumenframe.streaming import bounded
    # Twelve files, one per batch: all have the key 0, each one key of its own, one in three a null.
    for i in range(12):
        rows = [(0, i), (i + 1, i), *([(None, i)] if i % 3 == 0 else [])]
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    written = []
    add = bounded.Versions.add
    monkeypatch.setattr(bounded, "FANOUT", 4)
    monkeypatch.setattr(bounded.Versions, "add", lambda self, df, n: (written.append(df.count()), add(self, df, n))[1])
    held = []
    result = bounded.Versions.result
    monkeypatch.setattr(bounded.Versions, "result", lambda self: (held.append([t for c in self.classes for t in c]), result(self))[1])
    total = lambda df: df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = run_once(spark, str(tmp_path / "in"), schema, total, ["k"], files_per_batch=1)
    want = sorted(map(tuple, total(spark.read.parquet(str(tmp_path / "in"))).collect()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len([n for n in written if n]) == 12 and max(written) <= 3 and len(held[0]) <= 6
