"""Placeholder rewriting against token by token replacement, for any number of columns."""

import random
import time

from pyspark.sql import functions as F

from lumenframe.plans import context

TOKENS = context.TOKENS


def one_after_the_other(text, tokens):
    for token, (_, to) in sorted(tokens.items(), key=lambda e: e[1][0]):
        text = text.replace(token, to)
    return text


def replaced(spark, texts, tokens):
    held = spark.createDataFrame([({t: {"place": p, "text": to} for t, (p, to) in tokens.items()},)], f"tokens {TOKENS}")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").crossJoin(F.broadcast(held))
    return [r.t for r in df.select("i", context.replace_tokens(F.col("t"), F.col("tokens")).alias("t")).orderBy("i").collect()]


def test_tokens_see_earlier_output(spark):
    rng = random.Random(5)
    names = ["a", "b", "row", "x{y", "x}y", "p<q", "column:a", "a b"]
    for seed in range(4):
        tokens = {}
        for name in rng.sample(names, 6):
            for form in ("{%s}", "<%s>"):
                to = "".join(rng.choice(["v", "{a}", "<b>", "{", "}", "row", "a", "<x}y>", "<"]) for _ in range(rng.randint(1, 3)))
                tokens[form % name] = (len(tokens), to)
        texts = ["".join(rng.choice(["{a}", "<b>", "{x{y}", "<p<q>", "{row}", "{", "}", "<", ">", "a", "row", " {column:a}", "{a b}"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
        assert replaced(spark, texts, tokens) == [one_after_the_other(t, tokens) for t in texts]
    assert replaced(spark, ["{a}", "", "no token"], {}) == ["{a}", "", "no token"]


def test_a_thousand_columns(spark):
    def plan_of(width):
        names = [f"Col {i}" for i in range(width)]
        row = spark.createDataFrame([tuple(f"v{i}" for i in range(width))], ", ".join(f"`{n}` string" for n in names))
        snippets = spark.createDataFrame([("s", f"df {{value:Col {width - 1}}} <column:col_0> {{entity_column}} " + "some code <T> {x} " * 200)], "id string, snippet string")
        made = context.contextualize(snippets, row, "Wide", 1)
        return made, made.select("rule_based_draft")._jdf.queryExecution().optimizedPlan().toString()

    small, few = plan_of(5)
    start = time.time()
    wide, many = plan_of(1000)
    draft = wide.select("rule_based_draft").first()[0]
    assert draft.startswith("wide v999 Col 0 Col 0 some code <T> {x} ") and time.time() - start < 60
    assert len(many) < 1.2 * len(few) + 500
    assert small.first()["message"].count("Representative columns:") == 1


def test_snippet_files_of_all_kinds(spark):
    files = [("a/b.c.py", "  print(1)\n"), ("x.txt", " \n"), ("l.json", '["one", {"id": 7, "code": "two"}, {"snippet": " "}, 5]'), ("o.json", '{"snippet": "s"}'),
             ("e.json", "[]"), ("n.json", '{"snippets": []}'), ("bad.json", "{"), ("t.JSONL", '\n"one"\r\n\n{"id": "own", "snippet": "two"}\nnope\n3'), ("e.jsonl", "\n \n"), (None, "inline"), (None, None)]
    got = {}
    for r in context.load_snippets(spark.createDataFrame(files, "path string, text string")).collect():
        got.setdefault(r.path, []).append((r.position, r.id, r.snippet, r.error))
    kind, field = "entries must be JSON objects or strings", "entries must include a non-empty 'snippet' or 'code' field"
    assert got.pop(None) == [(1, "snippet-1", "inline", None), (0, None, None, "empty file")]
    assert got == {
        "a/b.c.py": [(1, "b.c", "print(1)", None)], "x.txt": [(0, None, None, "empty file")],
        "l.json": [(1, "snippet-1", "one", None), (2, "7", "two", None), (3, "snippet-3", None, field), (4, "snippet-4", None, kind)],
        "o.json": [(1, "snippet-1", "s", None)], "e.json": [(0, None, None, "no snippets found")], "n.json": [(0, None, None, "no snippets found")],
        "bad.json": [(0, None, None, "invalid JSON")], "e.jsonl": [(0, None, None, "no snippets found")],
        "t.JSONL": [(2, "snippet-2", "one", None), (4, "own", "two", None), (5, "snippet-5", None, "invalid JSON"), (6, "snippet-6", None, kind)]}
