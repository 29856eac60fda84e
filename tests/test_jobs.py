"""Snippet, chat and scoring jobs on small worked records."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenframe.plans import context, corpus, pairs, requests, scores, training_sets
from lumenframe.sources.lines import parse_lines


def values(df):
    return [tuple(r) for r in df.collect()]


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".py", v) for k, v in texts.items()], "path string, text string")


GOOD = "import x\n# --8<-- [start:df]\na = 1\n\nb = 2\n# --8<-- [end:df]\n\n# --8<- [start:equality]\nprint(a)\n# --8<- [end:equality]\n# --8<- [start:none]\n# --8<- [end:none]\n"


def test_blocks_and_lines(spark):
    got = corpus.segments(files(spark, io__good=GOOD, whole="one\ntwo\n", empty="")).orderBy("path", "ordinal")
    assert values(got) == [
        ("empty.py", 1, "file", 0, 1, 0, 0, ""),
        ("io/good.py", 1, "df", 2, 3, 5, 6, "a = 1\n\nb = 2\n"),
        ("io/good.py", 2, "equality", 8, 9, 9, 10, "print(a)\n"),
        ("io/good.py", 3, "none", 11, 12, 11, 12, ""),
        ("whole.py", 1, "file", 0, 1, 2, 0, "one\ntwo\n")]


def test_first_marker_fault(spark):
    f = files(spark, nested="--8<-- [start:a]\n--8<-- [start:b]\n", stray="x\n--8<-- [end:a]\n", other="--8<-- [start:a]\n--8<-- [end:b]",
              open="--8<-- [start:a]\nx", good=GOOD)
    assert sorted(values(corpus.violations(f))) == [
        ("nested.py", 2, "nested start"), ("open.py", 2, "unclosed a"), ("other.py", 2, "mismatched end: expected a, got b"),
        ("stray.py", 2, "unexpected end")]
    assert corpus.segments(f).select("path").distinct().count() == 1
    with pytest.raises(PySparkException):
        corpus.segments(f, strict=True).collect()


def test_record_fields(spark):
    recs = corpus.records(corpus.segments(files(spark, io__deep__group_by=GOOD)), "code", "numpy", "np")
    r = recs.where("source.snippet_ordinal = 1").first()
    assert r["id"] == "io/deep/group_by.py#df" and r["language"] == "python"
    assert r["metadata"]["path"]["context_label"] == "Io / Deep / Group By"
    assert r["metadata"]["snippet"].asDict() == {"label": "Df", "role": "data", "title": "Group By: Df"}
    assert r["metadata"]["inferred"]["tags"] == ["io", "deep", "group_by", "df", "data", "python"]
    assert r["metadata"]["inferred"]["purpose"] == "Builds example input data for the Io / Deep / Group By snippets."
    assert r["stats"].asDict() == {"line_count": 3, "char_count": 13, "has_import": False, "has_print": False, "has_library": False, "is_empty": False}
    assert values(corpus.summary(recs).orderBy("category")) == [(None, 1, 3), ("io", 1, 3)]


def test_operation_tags(spark):
    code = "df.group_by('a').agg(x).filter(y)\nout.JOIN(z).lazy()\nscan_csv(f)"
    got = spark.createDataFrame([(code,)], "c string").select(corpus.operations(F.col("c"))).first()[0]
    assert got == ["join", "group_by", "aggregation", "filter", "lazy", "csv"]
    joined = spark.createDataFrame([("JOIN(z) join_asof",)], "c string").select(corpus.operations(F.col("c"))).first()[0]
    assert joined == ["join_asof", "join"]


def test_paths_roles_and_languages(spark):
    df = spark.createDataFrame([("a/b/c/d.x.py",), ("top",), ("a/.hidden",), ("a/B.YML",)], "p string")
    got = [(r[0].asDict(), r[1]) for r in df.select(corpus.path_parts(F.col("p")), corpus.language(F.col("p"))).collect()]
    assert [(g[0]["category"], g[0]["subcategories"], g[0]["file_stem"], g[1]) for g in got] == [
        ("a", ["b", "c"], "d.x", "python"), ("root", [], "top", "text"), ("a", [], ".hidden", "text"), ("a", [], "B", "yaml")]
    names = {"file": "file", "Setup": "setup", "prepare_x": "setup", "df3": "data", "df_a": "data", "dfs": "example", "tokens": "data", "props_": "example"}
    roles = spark.createDataFrame([(n,) for n in names], "n string").select(corpus.role(F.col("n")))
    assert [r[0] for r in roles.collect()] == list(names.values())


SALES = [("CA-1", "11/8/2016", "Bush Bookcase", 261.96, None), ("CA-2", "6/12/2016", 'Say "hi"', 14.62, "x")]
SALES_DDL = "`Order ID` string, `Order Date` string, `Product Name` string, `Sales` double, `Note` string"


def test_contextualize(spark):
    table = spark.createDataFrame(SALES, SALES_DDL)
    snippets = spark.createDataFrame([("s1", ' df.filter(c("{metric_column}") > {value:Sales}) ', 1), ("s2", "{value:product_name}|<value:Note>|{column:order_id}|row", 2), ("s3", "  ", 3)],
                                     "id string, snippet string, extra int")
    row = lambda k: context.contextualize(snippets, table.where(F.col("Order ID") == k), "SampleSuperstore", 1)
    drafts = {(r["id"], r["tables"]["row"]["Order ID"]): r for k in ("CA-1", "CA-2") for r in row(k).collect()}
    assert len(drafts) == 6 and drafts["s3", "CA-1"]["error"] == "empty snippet" and drafts["s2", "CA-1"]["extra"] == 2
    with pytest.raises(PySparkException):
        context.contextualize(snippets, table.where("`Order ID` = 'CA-1'"), "S", 1, strict=True).collect()
    with pytest.raises(ValueError):
        context.contextualize(snippets, table, "S", 1)
    assert drafts["s1", "CA-1"]["rule_based_draft"] == 'sample_superstore.filter(c("Sales") > 261.96)'
    # An empty value is left as it stands.
    assert drafts["s2", "CA-1"]["rule_based_draft"] == "Bush Bookcase|<value:Note>|Order ID|sample_superstore_row"
    t = drafts["s2", "CA-2"]["tables"]
    assert t["representative_columns"] == {"entity_column": "Product Name", "metric_column": "Sales", "date_column": "Order Date", "id_column": "Order ID"}
    assert t["column_kinds"] == {"Order ID": "identifier", "Order Date": "date", "Product Name": "text", "Sales": "numeric", "Note": "text"}
    assert t["representative_values"]["entity_column"] == 'Say "hi"' and t["column_aliases"]["Order ID"] == "order_id"
    m = drafts["s2", "CA-2"]["message"]
    block = m.split("CSV row context:\n")[1].split("\n\nColumn aliases:")[0]
    row = {"Order ID": "CA-2", "Order Date": "6/12/2016", "Product Name": 'Say "hi"', "Sales": "14.62", "Note": "x"}
    assert t["row"] == row and block == json.dumps(row, indent=2, ensure_ascii=False)
    assert m.startswith("Contextualize the snippet") and m.endswith("Return only the final contextualized snippet.")


def test_replacement_order_and_words(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(context.replace_tokens(F.lit("{a} {b}"), context.token_map([("{a}", F.lit("{b}!")), ("{b}", F.lit("x"))]))) == "x! x"
    assert f(context.replace_words(F.lit("df df1 édf (df) row"), {"df": "t", "row": "t_row"})) == "t df1 édf (t) t_row"


def test_snippet_shapes(spark):
    docs = [(1, '{"snippets": ["a", {"code": "b", "snippet": " "}, {"id": "k", "snippet": "c"}]}'), (2, '["d", 5]'), (3, '{"code": "e"}'), (4, '"f"')]
    items = context.snippet_items(spark.createDataFrame(docs, "line int, v string").select("line", F.parse_json("v").alias("json")))
    got = context.normalized_snippets(items, F.col("position")).orderBy("line", "position")
    assert values(got.select("id", "snippet")) == [
        ("snippet-1", "a"), ("snippet-2", "b"), ("k", "c"), ("snippet-1", "d"), ("snippet-2", None), ("snippet-1", "e"), ("snippet-1", "f")]


def test_spaced_json(spark):
    for record in ({"a": [1, 2, {"b,": "c: \" \\ d"}], "e": None}, [], {"x": "", "y": {}}):
        compact = json.dumps(record, separators=(",", ":"))
        assert spark.range(1).select(requests.spaced_json(F.lit(compact))).first()[0] == json.dumps(record)


def chat(*turns):
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in turns]})


def test_chat_pairs(spark):
    data = [chat(("user", "q"), ("assistant", " a ")), chat(("user", "q")), '{"messages": "x"}', "{}", chat(("user", 5), ("assistant", "a")),
            chat(("user", "q"), ("assistant", "\n")), '{"messages": [1]}', chat(("robot", "q")), "not json", "  "]
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(data, 1)], "line long, value string")
    valid = pairs.validated(parse_lines(lines))
    assert dict(values(valid.select("line", "error"))) == {
        1: None, 2: "last message role must be 'assistant'", 3: "'messages' must be a non-empty list", 4: "missing 'messages' field",
        5: "messages[0] content must be a string", 6: "last assistant message is empty", 7: "messages[0] must be an object",
        8: "messages[0] has unsupported role", 9: "invalid JSON"}
    g = pairs.grpo_rows(valid, "line").first()
    assert g["answer"] == "a" and [tuple(m) for m in g["prompt"]] == [("user", "q")]
    assert values(pairs.counts(valid)) == [(9, 1, 1, 8)]


def test_turn_tables_match_records(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "robot", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "q"), (4, 0, "assistant", " ")]
    got = pairs.turn_table_errors(spark.createDataFrame(turns, "c int, t int, r string, x string"), "c", "t", "r", "x")
    assert dict((r["c"], r["error"]) for r in got.collect()) == {
        1: None, 2: "unsupported role", 3: "last message role must be 'assistant'", 4: "last assistant message is empty"}


def test_schema_pairs(spark):
    base = {"segment_id": "s", "question": " q ", "schema": [{"name": "z", "dtype": "i64", "non_null_sample": 1}], "answer": " a "}
    data = [base, {**base, "schema": {}}, {**base, "validation": {"contract_errors": ["e"]}}, {k: v for k, v in base.items() if k != "answer"}]
    lines = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data, 1)], "line long, value string")
    got = pairs.schema_pairs(parse_lines(lines), "value", "Spark").orderBy("line").collect()
    assert [r["error"] for r in got] == [None, "'schema' must be a list", "contract errors", "missing 'answer' field"]
    assert got[0]["sft"][0]["content"].endswith("Available schema: " + json.dumps(base["schema"]))
    assert got[0]["sft"][1]["content"] == "q" and got[0]["answer"] == "a" and got[0]["segment_id"] == "s"
    kept = pairs.schema_pairs(parse_lines(lines), "value", "Spark", keep_invalid=True).where("line = 3").first()
    assert kept["error"] is None


def test_content_shapes(spark):
    shapes = {'"a"': "a", '{"text": {"content": "b"}}': "b", '["c", {"type": "text", "text": "d"}, {"content": ["e", "f"]}, {"type": "image"}, 5]': "c\nd\ne\nf",
              "null": "", "[]": "", "3": "3"}
    df = spark.createDataFrame([(k,) for k in shapes], "v string").select(F.parse_json("v").alias("v"))
    assert [r[0] for r in df.select(training_sets.content_to_text(F.col("v"))).collect()] == list(shapes.values())


def test_documented_turn_text(spark):
    df = spark.createDataFrame([("What is a groupby?", "A groupby splits rows.")], "prompt string, response string")
    assert training_sets.sft_text(df).first()["text"] == "<|turn>user\nWhat is a groupby?<turn|>\n<|turn>model\nA groupby splits rows.<turn|>"


def test_gold_rows(spark):
    m = [("system", "s"), ("user", "q"), ("assistant", "4")]
    df = spark.createDataFrame([(m,), (m[:2],), ([],)], "messages array<struct<role:string,content:string>>")
    got = training_sets.grpo_set(df).collect()
    assert [(len(r["prompt"]), r["answer"], r["error"]) for r in got] == [(2, "4", None), (2, "", "empty gold answer"), (1, "", "empty gold answer")]
    with pytest.raises(ValueError):
        training_sets.grpo_set(spark.range(1))


def test_prompt_room(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a"), (3, "x " * 50)], "id int, t string")
    assert values(training_sets.longest_prompt_words(df, "t", 100)) == [(50, 49)]
    with pytest.raises(PySparkException):
        training_sets.longest_prompt_words(df, "t", 60).collect()


@pytest.mark.parametrize("completion, gold, want", [
    ("<reasoning>r</reasoning><answer> Paris\n </answer>", " paris ", (1.0, 0.25, 0.5, 2.0)),
    ("The capital is Paris", "paris", (0.0, 0.25, 0.5, 0.0)), ("", "paris", (0.0, -0.25, 0.0, 0.0)), ("x", " ", (0.0, 0.25, 0.0, 0.0)),
    ("<answer>a</answer> <answer>b</answer>", "b", (0.75, 0.25, 0.0, 0.0))])
def test_scores(spark, completion, gold, want):
    df = spark.createDataFrame([(completion, gold)], "c string, g string")
    r = scores.score_table(df, "c", "g").first()
    assert (r["format"], r["non_empty"], r["partial"], r["exact"]) == want and r["total"] == sum(want)
