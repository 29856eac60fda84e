"""CSV and encodings against Python's own reader, with files cut into small blocks."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import encodings, files, lines
from lumenframe.sources.csv import pick_record, scan_csv, write_csv

DDL = "id bigint, a string, b string, c string"
PIECES = ["a", '"', '""', ",", "\n", "\r\n", "é", "ü", " ", "x y", "", "\\", "'", "#"]


@pytest.fixture
def small_blocks(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(seed, n):
    rng = random.Random(seed)
    return [[str(i)] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))) for _ in range(3)] for i in range(n)]


def written(path, rows, encoding="utf-8", quoting=csv.QUOTE_ALL, header=("id", "a", "b", "c")):
    with open(path, "w", newline="", encoding=encoding) as f:
        w = csv.writer(f, quoting=quoting)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


@pytest.mark.parametrize("quoting", [csv.QUOTE_ALL, csv.QUOTE_MINIMAL])
@pytest.mark.parametrize("block", [400, 1 << 20])
def test_csv_of_another_writer_in_blocks_of_any_size(spark, tmp_path, small_blocks, quoting, block):
    rows = made(block, 250)
    rows[7][2] = "one, \"long\"\r\nfield\n" * 60  # goes through several blocks
    path = written(tmp_path / "a.csv", rows, quoting=quoting)
    small_blocks(block)
    got = scan_csv(spark, path, schema=DDL, number="n").collect()
    keep = lambda t: t if t or quoting == csv.QUOTE_ALL else None
    assert sorted(map(tuple, got)) == [(int(i), keep(a), keep(b), keep(c), n) for n, (i, a, b, c) in enumerate(rows, 1)]
    # A filter on parsed fields is not moved before the walk along the lines.
    assert sorted(r.id for r in scan_csv(spark, path, schema=DDL).where("a IS NOT NULL AND id % 3 = 0").collect()) == [
        int(r[0]) for r in rows if int(r[0]) % 3 == 0 and keep(r[1]) is not None]


def test_quotes_inside_unquoted_fields_and_after_closing_ones(spark, tmp_path, small_blocks):
    text = 'id,a,b\n1,5" pipe,x\n2,a"b"c,"q"\n\n\r\n3,"x\n""y""","z"\n4,""\n5,a,b,c\n'
    (tmp_path / "a.csv").write_text(text, newline="")
    small_blocks(9)
    got = scan_csv(spark, str(tmp_path / "a.csv"), schema="id int, a string, b string").collect()
    assert sorted(map(tuple, got)) == [(1, '5" pipe', "x"), (2, 'a"b"c', "q"), (3, 'x\n"y"', "z"), (4, "", None), (5, "a", "b")]


def test_states_agree_with_one_character_at_a_time(spark):
    rng = random.Random(4)
    found = ["".join(rng.choice('",ab') for _ in range(rng.randint(0, 12))) for _ in range(600)]

    def end(line, inside):
        state = "in" if inside else "start"
        for c in line:
            if state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote" and c == '"':
                state = "in"
            elif c == ",":
                state = "start"
            else:
                state = "in" if c == '"' and state == "start" else "field"
        return state == "in"

    from lumenframe.sources.csv import _ends
    df = spark.createDataFrame([(t,) for t in found], "t string").select("t", _ends(F.col("t"), ",").alias("e"))
    for t, e in df.collect():
        assert (e & 1, e >> 1) == (end(t, False), end(t, True)), t


def test_round_trip_keeps_empty_texts_and_nulls_apart(spark, tmp_path):
    rows = [(1, 'x "y" z', None), (2, "", " pad "), (3, "a\nb\r\nc", "\\"), (4, "\r", '"'), (5, None, '\\"'), (6, ",,", "﻿"), (7, "#c", "'")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for gzip in (False, True):
        back = scan_csv(spark, write_csv(df, str(tmp_path / f"w{gzip}"), gzip=gzip))
        assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_other_tools_read_what_is_written(spark, tmp_path):
    rows = [(str(i), t) for i, t in enumerate(['say "hi", ok', "two\nlines", "back\\slash", " spaces ", "plain"])]
    write_csv(spark.createDataFrame(rows, "i string, t string").coalesce(1), str(tmp_path / "w"))
    (part,) = (tmp_path / "w").glob("*.csv")
    with open(part, newline="") as f:
        assert [tuple(r) for r in csv.reader(f)] == [("i", "t"), *rows]


def test_faults_of_csv_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="not closed at the end of .*open.csv"):
        scan_csv(spark, str(tmp_path / "open.csv"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two/a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two/b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="differ in their headers"):
        scan_csv(spark, str(tmp_path / "two"))
    (tmp_path / "none.csv").write_text("")
    assert scan_csv(spark, str(tmp_path / "none.csv"), schema="a int, b string").collect() == []
    (tmp_path / "head.csv").write_text("a,,a\n")
    assert scan_csv(spark, str(tmp_path / "head.csv")).columns == ["a", "_c1", "a_c2"]


def test_types_are_inferred_and_overridden(spark, tmp_path):
    path = written(tmp_path / "t.csv", [["1", "2.5", "x", "2024-01-02"], ["2", "3", "y\nz", "2024-01-03"]], quoting=csv.QUOTE_MINIMAL)
    assert dict(scan_csv(spark, path).dtypes) == {"id": "int", "a": "double", "b": "string", "c": "date"}
    assert dict(scan_csv(spark, path, overrides={"id": "string"}).dtypes)["id"] == "string"


def test_one_record_is_picked_through_the_block_index(spark, tmp_path, small_blocks):
    parts = [made(1, 60), made(2, 1), made(3, 40)]
    parts[0][-1][3] = "ends\nwith\nbreaks " * 30
    for i, rows in enumerate(parts):
        written(tmp_path / f"{i}.csv", rows, encoding="cp1252" if i == 2 else "utf-8")
    small_blocks(400)
    every = [r for rows in parts for r in rows]
    for n in (1, 60, 61, len(every)):
        assert list(pick_record(spark, str(tmp_path), n=n).first()) == every[n - 1]
    with pytest.raises(ValueError, match="was not found"):
        pick_record(spark, str(tmp_path), n=len(every) + 1)
    with pytest.raises(ValueError, match="positive"):
        pick_record(spark, str(tmp_path), n=0)
    numbered = scan_csv(spark, str(tmp_path), schema="id string, a string, b string, c string", number="n", across=True)
    assert [list(r)[:4] for r in sorted(numbered.collect(), key=lambda r: r.n)] == every


def test_each_file_has_one_encoding(spark, tmp_path, small_blocks):
    # Most blocks of the first two files are plain ASCII: only the file as a whole tells its encoding.
    filler = "plain line\n" * 200
    texts = {"cp1252": "é “quoted” €\r\n" + filler + "né\r\n", "latin-1": "é \x81\n" + filler + "é\n", "utf-8-sig": "é “€”\n" + filler, "utf-8": "\x81é€\n"}
    for kind, text in texts.items():
        (tmp_path / f"{kind}.txt").write_bytes(text.encode(kind))
    small_blocks(300)
    got = encodings.scan_lines(spark, str(tmp_path)).groupBy("file").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
    assert {r.file.rsplit("/", 1)[1]: r.v for r in got} == {f"{k}.txt": sorted(t.splitlines()) if k != "utf-8" else ["\x81é€"] for k, t in texts.items()}
    whole = files.scan_sources(spark, str(tmp_path)).collect()
    assert {r.path: r.text for r in whole} == {f"{k}.txt": t for k, t in texts.items()}
    first = lines.numbered_lines(spark, str(tmp_path)).where("line = 1").collect()
    assert sorted(r.value for r in first) == sorted(t.splitlines()[0] for t in texts.values())


def test_json_in_any_encoding(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('{"i": 1, "t": "é€"}\n{"i": 2, "t": "x"}\n'.encode("cp1252"))
    (tmp_path / "b.jsonl").write_bytes('{"i": 3, "t": "é€"}\n'.encode("utf-8-sig"))
    got = files.scan_json(spark, str(tmp_path), "i int, t string", any_encoding=True).collect()
    assert sorted(map(tuple, got)) == [(1, "é€"), (2, "x"), (3, "é€")]
    assert files.scan_json(spark, str(tmp_path), any_encoding=True).dtypes == [("i", "bigint"), ("t", "string")]
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc/a.json").write_bytes('[{"i": 1, "t": "é€"}, {"i": 2, "t": "x"}]'.encode("cp1252"))
    assert sorted(map(tuple, files.scan_json(spark, str(tmp_path / "doc"), "i int, t string", lines=False, any_encoding=True).collect())) == [(1, "é€"), (2, "x")]


def test_utf8_files_are_read_without_a_join(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é\n")
    plan = encodings.scan_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
