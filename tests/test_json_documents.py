"""JSON documents cut into small blocks, against Python's own reader."""

import json
import random

import pytest

from lumenframe.sources.files import scan_json


def value(rng, depth):
    if depth == 0 or rng.random() < 0.5:
        return rng.choice(["}", '"', "\\", '\\"}', "{[", "a,b", "é€", "", "]"]) * rng.randint(1, 3)
    return {rng.choice("xyz"): value(rng, depth - 1)} if rng.random() < 0.6 else [value(rng, depth - 1)]


@pytest.mark.parametrize("block", [60, 700, 1 << 20])
def test_documents_in_blocks_of_any_size(spark, tmp_path, block):
    rng = random.Random(block)
    made = [{"i": i, "v": json.dumps(value(rng, 4)), "w": value(rng, 5)} for i in range(150)]
    made[40]["w"] = "}" * 2000  # an entry over many blocks
    (tmp_path / "a.json").write_text(json.dumps(made[:60], ensure_ascii=False, indent=2) + "\n")
    (tmp_path / "b.json").write_bytes(json.dumps(made[60:100], ensure_ascii=False).encode("utf-8-sig"))
    (tmp_path / "c.json").write_text(json.dumps(made[100], ensure_ascii=False))
    (tmp_path / "d.json").write_bytes((" [ " + " , ".join(json.dumps({**r, "v": "é€", "w": ""}, ensure_ascii=False) for r in made[101:]) + " ] ").encode("cp1252"))
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "f.json").write_text(" \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.i: (r.v, r.w) for r in scan_json(spark, str(tmp_path), "i int, v string, w string", lines=False).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == list(range(150))
    for r in made:
        v, w = got[r["i"]]
        want = r if r["i"] <= 100 else {"v": "é€", "w": ""}
        assert v == want["v"] and (w == want["w"] if isinstance(want["w"], str) else json.loads(w) == want["w"]), r["i"]


def test_types_are_found_and_entries_may_be_mixed(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": {"c": [1.5]}}, {"a": 2}]')
    got = scan_json(spark, str(tmp_path / "a.json"), lines=False)
    assert got.dtypes == [("a", "bigint"), ("b", "struct<c:array<double>>")] and sorted(r.a for r in got.collect()) == [1, 2]


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "x}]', '{"a": {', 'nonsense {"a": 1}'])
def test_documents_that_are_not_closed(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="not a closed JSON document: .*a.json"):
        scan_json(spark, str(tmp_path), "a int", lines=False)
