"""Order-dependent operators against plain Python, with hot keys, ties and nulls."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import joins, ordering as o, timeseries


def rows(seed, n=400):
    """A third of all rows has key `hot`; a third of the values is 7; some are null."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if r.random() < 0.34 else r.choice(["a", "b", None])
        at = 7 if r.random() < 0.34 else (None if r.random() < 0.1 else r.randrange(50))
        value = None if r.random() < 0.4 else float(r.randrange(100))
        out.append((i, key, at, value))
    r.shuffle(out)
    return out


SCHEMA = "id long, k string, at long, v double"


def grouped(data, keyed=True):
    """Rows per key by (at, id), nulls last."""
    by = defaultdict(list)
    for row in data:
        by[row[1] if keyed else 0].append(row)
    for part in by.values():
        part.sort(key=lambda x: (x[2] is None, x[2] or 0, x[0]))
    return by


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_row_numbers_and_running_totals(spark, seed, keyed):
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    keys = ["k"] if keyed else []
    got = {r["id"]: r["n"] for r in o.number_rows(df, "n", "at", "id", keys).collect()}
    sums = {r["id"]: r["s"] for r in o.running_total(df, "s", "id", "at", "id", keys).collect()}
    for part in grouped(data, keyed).values():
        total = 0
        for n, row in enumerate(part, 1):
            total += row[0]
            assert got[row[0]] == n and sums[row[0]] == total


def test_descending_numbers(spark):
    data = rows(3)
    got = {r["id"]: r["n"] for r in o.number_rows(spark.createDataFrame(data, SCHEMA), "n", "at", "id", ["k"], descending=True).collect()}
    for part in grouped(data).values():
        part.sort(key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        assert [got[r[0]] for r in part] == list(range(1, len(part) + 1))


@pytest.mark.parametrize("keyed", [True, False])
def test_fill_both_ways_and_interpolate(spark, keyed):
    data = rows(4)
    df = spark.createDataFrame(data, SCHEMA)
    keys = ["k"] if keyed else []
    filled = {r["id"]: r for r in o.fill(df, {"f": "v"}, "at", "id", keys, backward={"b": "v"}).collect()}
    smooth = {r["id"]: r for r in o.interpolate(df, "s", "v", "at", "id", keys, forward={"f": "v"}).collect()}
    assert len(filled) == len(smooth) == len(data)
    for part in grouped(data, keyed).values():
        known = [i for i, r in enumerate(part) if r[3] is not None]
        for i, row in enumerate(part):
            before = max((j for j in known if j <= i), default=None)
            after = min((j for j in known if j >= i), default=None)
            f = None if before is None else part[before][3]
            b = None if after is None else part[after][3]
            assert filled[row[0]]["f"] == f and filled[row[0]]["b"] == b and smooth[row[0]]["f"] == f
            s = f if f is None or b is None else (f if before == after else f + (b - f) * (i - before) / (after - before))
            if f is None or b is None:
                assert smooth[row[0]]["s"] is None
            else:
                assert smooth[row[0]]["s"] == pytest.approx(s)


@pytest.mark.parametrize("method", ["dense", "min"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(spark, method, descending):
    data = rows(5)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["id"]: r["r"] for r in o.rank_values(df, "r", ["k"], ["at"], method=method, descending=descending).collect()}
    pairs = {r["id"]: r["r"] for r in o.rank_values(df, "r", ["k"], ["at", "v"], method=method, descending=descending).collect()}
    for part in grouped(data).values():
        for row in part:
            values = [r[2] for r in part if r[2] is not None]
            ahead = [x for x in values if row[2] is not None and ((x > row[2]) if descending else (x < row[2]))]
            assert got[row[0]] == (None if row[2] is None else 1 + (len(set(ahead)) if method == "dense" else len(ahead)))
            if row[2] is None or row[3] is None:
                assert pairs[row[0]] is None
                continue
            both = [(r[2], r[3]) for r in part if r[2] is not None and r[3] is not None]
            ahead = [x for x in both if ((x > (row[2], row[3])) if descending else (x < (row[2], row[3])))]
            assert pairs[row[0]] == 1 + (len(set(ahead)) if method == "dense" else len(ahead))


def test_buckets_follow_the_order_and_cut_hot_values(spark):
    df = spark.createDataFrame(rows(6, 2000), SCHEMA)
    b = o.with_order_bucket(df, "at", "id", parts=8).collect()
    b.sort(key=lambda r: (r["at"] is None, r["at"] or 0, r["id"]))
    assert [r[o.BUCKET] for r in b] == sorted(r[o.BUCKET] for r in b)
    sizes = defaultdict(int)
    for r in b:
        sizes[r[o.BUCKET]] += 1
    assert max(sizes.values()) < 2000 / 4


def test_text_order_key(spark):
    data = [(i, f"name{(i * 37) % 500:03d}") for i in range(500)]
    df = spark.createDataFrame(data, "id long, name string")
    got = {r["name"]: r["n"] for r in o.number_rows(df, "n", "name", "id").collect()}
    assert [got[n] for n in sorted(got)] == list(range(1, 501))


@pytest.mark.parametrize("within", [None, 3])
def test_as_of_on_a_hot_key(spark, within):
    left, right = rows(7), rows(8)
    a = spark.createDataFrame(left, SCHEMA)
    b = spark.createDataFrame(right, SCHEMA).withColumnRenamed("id", "rid").drop("v")
    got = {r["id"]: r["rid"] for r in joins.as_of(a, b, "at", ["rid"], ["k"], tie="rid", within=within).collect()}
    assert len(got) == len(left)
    for i, k, at, _ in left:
        best = None
        for rid, rk, rat, _ in right:
            if k is not None and rk == k and at is not None and rat is not None and rat <= at:
                best = max(best or (-1, -1), (rat, rid))
        if best and within is not None and at - best[0] > within:
            best = None
        assert got[i] == (best[1] if best else None)


def test_range_join_with_a_hot_cell(spark):
    r = random.Random(9)
    points = [(i, 5.0 if i % 3 == 0 else r.uniform(0, 200)) for i in range(300)]
    spans = [(i, lo := r.uniform(-5, 200), lo + r.uniform(0, 12)) for i in range(80)]
    spans.append((99, 4.0, 5.0))
    got = joins.range_join(spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, lo double, hi double"),
                           "x", "lo", "hi", width=3.0)
    want = sorted((p, s) for p, x in points for s, lo, hi in spans if lo < x <= hi)
    assert sorted((x["p"], x["s"]) for x in got.select("p", "s").collect()) == want


def test_group_statistics_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, v int")
    got = {(r["k"], r["v"], r["s"]) for r in joins.with_group_statistics(df, ["k"], s=F.sum("v")).collect()}
    assert got == {("a", 1, 3), ("a", 2, 3), (None, 5, 5)}


def test_many_buckets(spark):
    data = [(i, (i * 7919) % 5000 if i % 3 else 77) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, at long")
    got = {r["id"]: r["n"] for r in o.number_rows(df, "n", "at", "id", parts=300).collect()}
    assert [got[i] for i, _ in sorted(data, key=lambda x: (x[1], x[0]))] == list(range(1, 3001))
    b = o.with_order_bucket(df, "at", "id", parts=300)
    assert b.groupBy(o.BUCKET).count().agg(F.max("count")).first()[0] < 60


def test_ordered_scans_shuffle_rows_once(spark):
    df = spark.createDataFrame(rows(10), SCHEMA)
    for made in (o.number_rows(df, "n", "at", "id", ["k"]), o.fill(df, {"f": "v"}, "at", "id", ["k"])):
        p = made._jdf.queryExecution().executedPlan().toString()
        # Rows, per-bucket sums, their order along the key, and the join of the sums.
        assert p.count("Exchange hashpartitioning") <= 4


def test_broadcast_sides_are_checked(spark):
    assert joins.bounded(spark.range(10)) and not joins.bounded(spark.range(10), rows=9)
    assert not joins.bounded(spark.range(3).select(F.repeat(F.lit("x"), 50).alias("t")), size=100)
    a, b = spark.range(4).toDF("x"), spark.range(5).toDF("y")
    assert joins.cross(a, b).count() == 20 and joins.join_where(a, b, F.col("x") > F.col("y")).count() == 6


def sizes_of(df, order, tie, parts, descending=False):
    b = o.with_order_bucket(df, order, tie, parts=parts, descending=descending).collect()
    key = lambda r: (r[order] is None, r[order] or "")
    b.sort(key=lambda r: r[tie])
    b.sort(key=(lambda r: (r[order] is not None, r[order] or "")) if descending else key, reverse=descending)
    assert [r[o.BUCKET] for r in b] == sorted(r[o.BUCKET] for r in b)
    sizes = defaultdict(int)
    for r in b:
        sizes[r[o.BUCKET]] += 1
    return sizes


@pytest.mark.parametrize("descending", [False, True])
def test_texts_with_long_common_prefixes_are_cut_evenly(spark, descending):
    site = "https://example.org/" + "a" * 80  # 100 characters that most rows begin with
    deep = site + "/" + "b" * 300  # and a third of them 301 more
    data = [(i, site + f"/{i % 997:04d}") for i in range(1500)] + [(i, deep + f"/{i * 7 % 1000:04d}") for i in range(1500, 2400)]
    data += [(i, f"other {i}") for i in range(2400, 2600)] + [(i, None) for i in range(2600, 2650)]
    sizes = sizes_of(spark.createDataFrame(data, "id int, url string"), "url", "id", 10, descending)
    assert len(sizes) >= 8 and max(sizes.values()) < 2 * 2650 / 10


def test_one_long_text_that_many_rows_hold_is_cut_by_the_tie(spark):
    hot = "the same long text " * 20
    data = [(i, hot) for i in range(1200)] + [(i, hot + f"{i}") for i in range(1200, 1500)] + [(i, hot[:70] + f"{i}") for i in range(1500, 1800)]
    sizes = sizes_of(spark.createDataFrame(data, "id int, t string"), "t", "id", 8)
    assert len(sizes) >= 7 and max(sizes.values()) < 2 * 1800 / 8


def test_sample_tells_the_number_of_rows(spark):
    picked, n = o._draw(spark.range(100_000).select(F.col("id").alias("v")), 2_000, "v")
    assert len(picked) == 2_000 and 90_000 < n < 110_000 and [r["v"] for r in picked] == sorted(r["v"] for r in picked)
    assert o._draw(spark.range(10).select(F.col("id").alias("v")), 2_000, "v")[1] == 10


def test_upsampling_of_a_hot_key_across_buckets(spark):
    rng = random.Random(9)
    data = sorted({(rng.randint(0, 5000), rng.choice(["hot"] * 5 + ["b", "c"])) for _ in range(700)})
    data = [(i, t, k, rng.choice([None, float(rng.randint(0, 99))])) for i, (t, k) in enumerate(data)] + [(9000, 40, "one", 1.0), (9001, None, "b", 5.0)]
    df = spark.createDataFrame(data, "id int, s int, k string, v double").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    seconds = F.unix_seconds(F.col("at").cast("timestamp")).alias("s")
    up = sorted((r.k, r.s, r.id) for r in timeseries.upsample(df, "at", 7_000_000, ["k"], ["id"], tie="id").select("k", seconds, "id").collect())
    smooth = sorted(((r.k, r.s, r.v, r.id) for r in timeseries.upsample_interpolate(df, "at", 7_000_000, ["k"], "v", ["id"]).select("k", seconds, "v", "id").collect()), key=lambda r: r[:2])
    want, lines = [], []
    for k in ("b", "c", "hot", "one"):
        part = sorted((t, i, v) for i, t, kk, v in data if kk == k and t is not None)
        known = [(t, v) for t, _, v in part if v is not None]
        for s in range(part[0][0], part[-1][0] + 1, 7):
            i = max(x for x in part if x[0] <= s)[1]
            want.append((k, s, i))
            a, b = max((x for x in known if x[0] <= s), default=None), min((x for x in known if x[0] >= s), default=None)
            lines.append((k, s, None if not a or not b else a[1] if a[0] == s else a[1] + (b[1] - a[1]) * ((s - a[0]) / (b[0] - a[0])), i))
    assert up == want
    assert [r[:2] + r[3:] for r in smooth] == [r[:2] + r[3:] for r in lines]
    assert [r[2] for r in smooth] == [pytest.approx(r[2]) if r[2] is not None else None for r in lines]


def test_upsampling_reads_its_source_once(spark, tmp_path):
    spark.createDataFrame([(i, "k", 1.0) for i in range(50)], "s int, k string, v double").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz")).write.parquet(str(tmp_path / "t"))
    made = timeseries.upsample(spark.read.parquet(str(tmp_path / "t")), "at", 500_000, ["k"], ["v"])
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Scans below a reused exchange are shown once.
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
