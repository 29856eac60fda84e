"""Small worked inputs with known results."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenframe import selectors as s
from lumenframe.functions import nested, numeric, temporal, text
from lumenframe.operators import aggregates, grouped, joins, reshape, timeseries
from lumenframe.session import scratch_dir
from lumenframe.sources import files, lines


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, **data):
    df = spark.createDataFrame([tuple(data.values())], list(data)) if data else spark.range(1)
    return df.select(column).first()[0]


def at(hour, minute=0):
    return dt.datetime(2020, 1, 1, hour, minute)


def test_selectors_are_sets(spark):
    df = spark.createDataFrame([("A", 1, 2.0, True, False)], "ticker string, n int, day_high double, has_kids boolean, is_alive boolean")
    assert (s.numeric() | s.string()).names(df) == ["ticker", "n", "day_high"]
    assert (s.all_columns() - s.first() - s.last()).names(df) == ["n", "day_high", "has_kids"]
    assert (~s.starts_with("has_")).names(df) == ["ticker", "n", "day_high", "is_alive"]
    assert (s.boolean() & s.starts_with("has_")).names(df) == ["has_kids"]
    assert df.select(*s.boolean().negated(df)).first().asDict() == {"has_kids": False, "is_alive": True}


def test_trades_and_quotes(spark):
    trades = spark.createDataFrame([(at(9, 1), "A", 101), (at(9, 1), "B", 299), (at(9, 3), "B", 301), (at(9, 6), "C", 500)],
                                   "time timestamp_ntz, stock string, trade int")
    quotes = spark.createDataFrame([(at(9, 0), "A", 100), (at(9, 2), "B", 300), (at(9, 4), "C", 501), (at(9, 6), "A", 102)],
                                   "time timestamp_ntz, stock string, quote int")
    plain = joins.as_of(trades, quotes, "time", ["quote"], ["stock"])
    assert sorted(values(plain.select("stock", "trade", "quote"))) == [("A", 101, 100), ("B", 299, None), ("B", 301, 300), ("C", 500, 501)]
    near = joins.as_of(trades, quotes, "time", ["quote"], ["stock"], within=60_000_000)
    assert sorted(values(near.select("stock", "trade", "quote"))) == [("A", 101, 100), ("B", 299, None), ("B", 301, 300), ("C", 500, None)]


def test_players_who_can_afford(spark):
    players = spark.createDataFrame([("Alice", 78), ("Bob", 135)], "name string, cash int")
    props = spark.createDataFrame([("Road", 60), ("Place", 80), ("Street", 140)], "prop string, cost int")
    got = joins.join_where(players, props, F.col("cash") > F.col("cost"))
    assert sorted(values(got.select("name", "prop"))) == [("Alice", "Road"), ("Bob", "Place"), ("Bob", "Road")]


def test_full_join_with_one_and_two_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "p"), (3, "q")], "k int, b string")
    assert sorted(values(joins.full_join(a, b, "k", "k")), key=str) == sorted(
        [(1, "x", None, None), (2, "y", 2, "p"), (None, None, 3, "q")], key=str)
    assert sorted(values(joins.full_join(a, b, "k", "k", coalesce=True))) == [(1, "x", None), (2, "y", "p"), (3, None, "q")]


def test_windows_closed_on_both_ends(spark):
    half = [(at(0) + dt.timedelta(minutes=30 * i), g) for i, g in enumerate("aaabbaa")]
    df = spark.createDataFrame(half, "time timestamp_ntz, g string")
    got = timeseries.windows_closed_both(df, "time", 3_600_000_000, ["g"], F.count(F.lit(1)).alias("n"))
    want = [("a", at(0) - dt.timedelta(hours=1), 1), ("a", at(0), 3), ("a", at(1), 1), ("a", at(2), 2), ("a", at(3), 1),
            ("b", at(1), 2), ("b", at(2), 1)]
    assert sorted(values(got.select("g", "lower", "n"))) == want


def test_upsample_forward_and_interpolated(spark):
    df = spark.createDataFrame([(at(0), "a", 1.0), (at(0, 30), "a", 3.0), (at(1, 30), "a", 7.0)], "time timestamp_ntz, g string, v double")
    step = 900_000_000
    got = timeseries.upsample(df, "time", step, ["g"], ["v"]).orderBy("time")
    assert [r["v"] for r in got.collect()] == [1.0, 1.0, 3.0, 3.0, 3.0, 3.0, 7.0]
    smooth = timeseries.upsample_interpolate(df.withColumn("w", F.col("g")), "time", step, ["g"], "v", ["w"]).orderBy("time")
    assert [r["v"] for r in smooth.collect()] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    assert {r["w"] for r in smooth.collect()} == {"a"}


def test_long_grids_come_in_steps(spark):
    df = spark.createDataFrame([(at(0), "a"), (at(0) + dt.timedelta(seconds=10_000), "a")], "time timestamp_ntz, g string")
    grid = timeseries.upsample(df.withColumn("v", F.lit(1)), "time", 1_000_000, ["g"], ["v"])
    assert grid.count() == grid.select("time").distinct().count() == 10_001


def test_special_division(spark):
    got = [one(spark, numeric.true_div(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 0), (-1, 0), (1, 4))]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, 0.25]


def test_remainder_and_floor_division(spark):
    assert one(spark, numeric.remainder(F.lit(-5), F.lit(3))) == 1 and one(spark, numeric.floor_div(F.lit(-5), F.lit(3))) == -2
    assert one(spark, numeric.floor_div(F.lit(-5), F.lit(0))) is None


def test_strict_and_lenient_casts(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(2**40,)], "n long").select(F.col("n").cast("int")).collect()
    with pytest.raises(PySparkException):
        spark.createDataFrame([("x",)], "n string").select(F.col("n").cast("int")).collect()
    assert one(spark, F.col("n").try_cast("int"), n="x") is None


def test_text_functions(spark):
    assert one(spark, text.replace_first(F.col("t"), r"\d", "-"), t="a\n1b2") == "a\n-b2"
    assert one(spark, text.extract(F.col("t"), r"candidate=(\w+)", 1), t="no match") is None
    assert one(spark, text.head(F.col("t"), F.lit(-2)), t="pêra") == "pê" and one(spark, text.tail(F.col("t"), F.lit(-1)), t="pêra") == "êra"
    assert one(spark, text.slice_text(F.col("t"), F.lit(-3), F.lit(2)), t="pear") == "ea"
    assert one(spark, text.title_case(F.col("t")), t="o'neil rust-blvd") == "O'Neil Rust-Blvd"
    assert one(spark, text.strip(F.col("t")), t="  a b\n\t") == "a b"
    assert [one(spark, text.slug(F.col("t")), t=x) for x in ("SampleSuperstore", "Order ID", "--", " HTTPServer2Go ")] == [
        "sample_superstore", "order_id", "value", "http_server2_go"]
    assert one(spark, text.slug_label(F.col("t")), t="group_by-dynamic") == "Group By Dynamic" and one(spark, text.slug_label(F.col("t")), t="-") == "Root"
    fences = {"```python\nx\n```": "x", " ```\ny\n``` ": "y", "```z": "z", "w```": "w", "plain": "plain"}
    assert [one(spark, text.strip_code_fence(F.col("t")), t=k) for k in fences] == list(fences.values())


def test_list_functions(spark):
    assert one(spark, nested.list_slice(F.array(*map(F.lit, [1, 2, 3, 4])), -3, 2)) == [2, 3]
    assert one(spark, nested.list_slice(F.array(F.lit(1)), -3, 2)) == []
    assert one(spark, nested.entropy(F.array(F.lit(5), F.lit(7)))) == pytest.approx(0.679193, abs=1e-6)
    assert one(spark, nested.rank_share(F.array(*map(F.lit, [20, 10, 20])))) == [0.5, 1.0, 0.5]
    with pytest.raises(PySparkException):
        one(spark, nested.fixed_size(F.array(F.lit(1)), 2))
    odd = ["5", " +5 ", "5.0", "x", "", "99999999999999999999"]
    assert [one(spark, nested.not_whole_number(F.col("t")), t=x) for x in odd] == [False, False, True, True, True, True]


def test_ordered_categories(spark):
    levels = ["debug", "info", "warning", "error"]
    df = spark.createDataFrame([(x,) for x in ("error", "debug", "info", "info")], "level string")
    assert df.where(nested.ordinal(F.col("level"), levels) > 1).count() == 3
    with pytest.raises(PySparkException):
        df.select(nested.checked(F.col("level"), levels[:2])).collect()


def test_unique_counts_a_null_once(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (1,)], "v int")
    assert df.agg(aggregates.n_unique(F.col("v"))).first()[0] == 2


def test_lists_keep_nulls_and_order(spark):
    df = spark.createDataFrame([(i, "hot", None if i == 4 else i) for i in range(10)], "id int, k string, v int")
    got = aggregates.collect_lists(df, ["k"], "v", "id")
    assert [r["v"] for r in got.collect()] == [[0, 1, 2, 3, None, 5, 6, 7, 8, 9]]


def test_stacking_needs_one_shape(spark):
    a, b = spark.range(1).toDF("id"), spark.range(1).toDF("x")
    with pytest.raises(ValueError):
        reshape.stack_rows(a, b)
    assert reshape.stack_diagonal(a, b).columns == ["id", "x"]


def test_empty_lists_keep_their_row(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [], [])], "id int, x array<int>, y array<string>")
    assert sorted(values(reshape.explode_lists(df, "x", "y")), key=str) == [(1, 1, "a"), (1, 2, "b"), (2, None, None)]


def test_offsets_and_formats(spark):
    day = F.lit("2021-03-27 23:00:00").cast("timestamp_ntz")
    assert one(spark, temporal.zone_convert(day, "UTC", "Asia/Kathmandu")) == dt.datetime(2021, 3, 28, 4, 45)
    assert one(spark, temporal.parse_offset(F.col("t"), "%Y-%m-%dT%H:%M:%S%z", "Europe/Brussels"), t="2021-03-28T00:00:00+0100") == dt.datetime(2021, 3, 28, 0, 0)
    assert one(spark, temporal.format_time(day, "%d %h %Y at %H:%M")) == "27 Mar 2021 at 23:00"
    assert one(spark, temporal.parse_date(F.col("t"), "%Y-%m-%d", strict=False), t="nope") is None


def test_mixed_folders_need_a_glob(spark):
    folder = files.write_parquet(spark.range(10).withColumn("p", F.col("id") % 2), scratch_dir(spark, "mixed"), ["p"])
    spark.createDataFrame([("note",)], "v string").write.mode("append").text(f"{folder}/p=0")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        spark.read.parquet(folder).collect()
    assert files.scan_parquet(spark, folder, glob="*.parquet").count() == 10


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        files.scan_any(spark, "/data/a.xlsx")


def test_line_numbers_hold_over_many_splits(spark):
    folder = scratch_dir(spark, "lines")
    text_lines = [("" if i % 10 == 3 else f"line {i}",) for i in range(1, 201)]
    spark.createDataFrame(text_lines, "v string").coalesce(1).write.text(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = lines.numbered_lines(spark, folder)
        assert got.rdd.getNumPartitions() >= 1
        numbered = {r["line"]: r["value"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert numbered == {i: v for i, (v,) in enumerate(text_lines, 1)}


def test_strict_parsing_names_the_first_bad_line(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, " "), (4, "[1]"), (3, "{")], "line long, value string")
    parsed = lines.parse_lines(df)
    assert sorted(values(parsed.select("line", "error"))) == [(1, None), (3, "invalid JSON"), (4, "must be a JSON object")]
    with pytest.raises(ValueError, match="Line 3: invalid JSON"):
        lines.require_clean(parsed)


def test_encodings(spark):
    data = [(1, "é".encode("utf-8-sig")), (2, "é".encode()), (3, "é€".encode("cp1252")), (4, b"\xe9\x81")]
    got = dict(values(spark.createDataFrame(data, "id int, b binary").select("id", lines.decode_bytes(F.col("b")))))
    assert got == {1: "é", 2: "é", 3: "é€", 4: "é\x81"}


def test_batches_must_answer_each_prompt(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id int, p string")
    good = grouped.batch_generate(df, lambda ps: [p + "!" for p in ps], "p", "r", batch=2)
    assert sorted(values(good.select("r"))) == [(f"p{i}!",) for i in range(5)]
    with pytest.raises(PySparkException):
        grouped.batch_generate(df, lambda ps: ps[:1], "p", "r", batch=2).collect()


def test_scratch_goes_to_the_shared_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
