"""Nested content against a plain recursion, for values of any shape and depth."""

import json
import random

from pyspark.sql import functions as F

from lumenframe.functions.content import completion_to_text, content_to_text, nesting
from lumenframe.plans import scores, training_sets


def shown(value):
    return value if isinstance(value, str) else str(value) if isinstance(value, (int, bool)) else "" if value is None else json.dumps(value, separators=(",", ":"))


def joined(parts):
    return "\n".join(p for p in parts if p).strip()


def content(value):
    if isinstance(value, dict) and ("text" in value or "content" in value):
        return content(value["text"] if "text" in value else value["content"])
    if not isinstance(value, list):
        return shown(value)
    return joined(x if isinstance(x, str) else "" if not isinstance(x, dict) else shown(x.get("text", "")) if x.get("type") == "text"
                  else content(x["content"]) if "content" in x else "" for x in value)


def completion(value):
    if isinstance(value, list):
        return joined(map(completion, value))
    return content(value.get("content", value) if isinstance(value, dict) else value)


def made(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(["a", " b ", "", "x\ny", ' {"[', None, 5, True, False, -3, ']\\"', "\t"])
    if rng.random() < 0.4:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    keys = rng.sample(["text", "content", "type", "role"], rng.randint(0, 3))
    return {k: rng.choice(["text", "image", 3]) if k == "type" else made(rng, depth - 1) for k in sorted(keys)}


def test_walk_against_recursion(spark):
    rng = random.Random(3)
    values = [made(rng, 6) for _ in range(500)] + [["x"] * 3000, [{"type": "text", "text": "y"}] * 500, [{"content": ["p", {"content": "q"}]}] * 200]
    deep, lists = "c", ["c"]
    for _ in range(300):
        deep = {"content": deep}
    for _ in range(100):
        lists = ["a ", {"content": lists}, " "]
    values += [deep, lists]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").repartition(4).withColumn("v", F.parse_json("j"))
    rows = df.select("i", content_to_text(F.col("v")).alias("a"), completion_to_text(F.col("v")).alias("b"), nesting(F.col("j")).alias("n"))
    depth = lambda v: 1 + max(map(depth, v if isinstance(v, list) else v.values()), default=0) if isinstance(v, (list, dict)) else 0
    for r in rows.collect():
        assert (r.a, r.b, r.n) == (content(values[r.i]), completion(values[r.i]), depth(values[r.i])), values[r.i]


def test_training_sets_and_scores_stay_out_of_python(spark):
    df = spark.createDataFrame([('[{"role": "user", "content": ["q"]}]', '{"text": "4"}')], "m string, g string").select(
        F.parse_json("m").alias("messages"), F.parse_json("g").alias("g"))
    for made_of in (training_sets.sft_text(df), scores.score_table(df, "messages", "g"), training_sets.grpo_set(df.drop("g"))):
        plan = made_of._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
