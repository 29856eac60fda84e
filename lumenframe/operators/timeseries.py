"""Calendar windows and regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BUCKET, KEY, keyed, with_order_bucket

SPAN_STEPS = 4096


def calendar_start(c: Column, every: str) -> Column:
    """Left edge of the calendar window: year, quarter, month, week, day, hour …"""
    return F.date_trunc(every, c)


def windows_closed_both(df: DataFrame, time: str, every_us: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """Fixed windows closed at both ends: a row on an edge counts in two windows."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    start = micros - F.pmod(micros, F.lit(every_us))
    starts = F.when(micros == start, F.array(start - every_us, start)).otherwise(F.array(start))
    spread = df.withColumn("_start", F.explode(starts))
    made = spread.groupBy(*keys, "_start").agg(*aggregates)
    edge = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return made.select(*keys, edge(F.col("_start")).alias("lower"), edge(F.col("_start") + every_us).alias("upper"),
                       *[c for c in made.columns if c not in (*keys, "_start")])


def _neighbours(df: DataFrame, time: str, keys: list[str], behind: dict[str, str], ahead: dict[str, str], bounds_from: DataFrame) -> DataFrame:
    """Per row: `_t`, its time in microseconds; `_low`, the first time of its key; `_next`, the time of the next row of its key; the
    last value of each `target: source` in `behind` that is not null, its own included; and the first in `ahead` of the rows after it.

    Rows are cut into buckets by time and shuffled once by key and bucket. The windows run there, and the table with one row per
    key and bucket that carries values across buckets is made from the same shuffle, so the source is read once. Expects one row
    per key and time.
    """
    b = keyed(with_order_bucket(df.where(F.col(f"`{time}`").isNotNull()), time, bounds_from=bounds_from), keys)
    b = b.withColumn("_t", F.unix_micros(F.col(f"`{time}`").cast("timestamp"))).repartition(KEY, BUCKET)
    ahead = {**ahead, "_next": "_t"}
    known = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.col("_t"))
    ends = b.groupBy(KEY, BUCKET).agg(
        # Naming all columns keeps them in the shuffle, so that both uses share it.
        F.when(F.first(F.struct(*[c for c in b.columns if c not in (KEY, BUCKET)])).isNotNull(), F.min("_t")).alias("_first"), *[F.max_by(F.col(f"`{c}`"), known(c)).alias(f"_e_{t}") for t, c in behind.items()],
        *[F.min_by(F.col(f"`{c}`"), known(c)).alias(f"_e_{t}") for t, c in ahead.items()])
    by_bucket = Window.partitionBy(KEY).orderBy(BUCKET)
    past, future = by_bucket.rowsBetween(Window.unboundedPreceding, -1), by_bucket.rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(
        KEY, BUCKET, F.min("_first").over(Window.partitionBy(KEY)).alias("_low"),
        *[F.last(f"_e_{t}", ignorenulls=True).over(past).alias(f"_c_{t}") for t in behind],
        *[F.first(f"_e_{t}", ignorenulls=True).over(future).alias(f"_c_{t}") for t in ahead])
    local = Window.partitionBy(KEY, BUCKET).orderBy("_t")
    so_far, after = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(1, Window.unboundedFollowing)
    inside = b.select("*", *[F.last(F.col(f"`{c}`"), ignorenulls=True).over(so_far).alias(f"_l_{t}") for t, c in behind.items()],
                      *[F.first(F.col(f"`{c}`"), ignorenulls=True).over(after).alias(f"_l_{t}") for t, c in ahead.items()])
    joined = inside.join(carry, [KEY, BUCKET])
    made = [*behind, *ahead]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "_t", "_low", *[F.coalesce(f"_l_{t}", f"_c_{t}").alias(t) for t in made])


def _expanded(rows: DataFrame, every_us: int, keys: list[str]) -> DataFrame:
    """Each row once per grid point `_at` from its time to before the next row's; the grid begins at the key's first time.

    A long gap is listed in two steps, and its steps are dealt out, so no row and no task holds all of a gap.
    """
    step = F.lit(every_us)
    on_grid = lambda n: F.col("_low") + n * step
    first = on_grid(F.expr(f"(_t - _low + {every_us - 1}) div {every_us}"))
    # The last row of a key has its own time only.
    last = on_grid(F.expr(f"(coalesce(_next - 1, _t) - _low) div {every_us}"))
    rows = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    coarse = rows.withColumn("_from", F.explode(F.sequence("_first", "_last", F.lit(every_us * SPAN_STEPS)))).repartition(*keys, "_from")
    until = F.least(F.col("_last"), F.col("_from") + F.lit(every_us * (SPAN_STEPS - 1)))
    return coarse.withColumn("_at", F.explode(F.sequence(F.col("_from"), until, step)))


def upsample(df: DataFrame, time: str, every_us: int, keys: list[str], values: list[str], tie: str | None = None) -> DataFrame:
    """Regular grid per key, from its first to its last time, each point with the last known row's values: every row lists the grid
    points up to the next one. Rows without a time are left out; null is a key like others."""
    packed = F.struct(*[F.col(f"`{c}`") for c in values])
    latest = df.groupBy(*keys, time).agg((F.max_by(packed, F.col(f"`{tie}`")) if tie else F.max(packed)).alias("_v"))
    spread = _expanded(_neighbours(latest, time, keys, {}, {}, df.select(time)), every_us, keys)
    return spread.select(*keys, F.timestamp_micros("_at").cast("timestamp_ntz").alias(time), *[F.col("_v")[c].alias(c) for c in values])


def upsample_interpolate(df: DataFrame, time: str, every_us: int, keys: list[str], number: str, rest: list[str]) -> DataFrame:
    """Regular grid per key: `number` interpolated in time between known values, `rest` filled forward; outer nulls stay.

    Expects at most one row per key and time.
    """
    value = F.col(f"`{number}`")
    known = F.when(value.isNotNull(), F.struct(F.unix_micros(F.col(f"`{time}`").cast("timestamp")).alias("t"), value.cast("double").alias("v")))
    rows = df.select(*keys, time, *rest, known.alias("_known"))
    near = _neighbours(rows, time, keys, {"_a": "_known", **{f"_f_{c}": c for c in rest}}, {"_b": "_known"}, df.select(time))
    a, b, at = F.col("_a"), F.col("_b"), F.col("_at")
    between = a["v"] + (b["v"] - a["v"]) * ((at - a["t"]).cast("double") / (b["t"] - a["t"]).cast("double"))
    return _expanded(near, every_us, keys).select(
        *keys, F.timestamp_micros(at).cast("timestamp_ntz").alias(time), F.when(a["t"] == at, a["v"]).otherwise(between).alias(number),
        *[F.col(f"_f_{c}").alias(c) for c in rest])


def date_range(df: DataFrame, low: Column, high: Column, step: str, name: str) -> DataFrame:
    """Each row spread over the dates from low to high."""
    return df.withColumn(name, F.explode(F.sequence(low, high, F.expr(f"interval {step}"))))
