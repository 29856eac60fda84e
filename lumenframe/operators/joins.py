"""Joins Spark has no direct form for: as-of, range, whole-frame statistics, cross."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import fill, join_back, with_order_bucket

BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 64 << 20
#: The level of spans without an end.
WHOLE = -1


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the frame is within a number of rows and of text bytes.

    Spark looks at a few partitions at a time and stops at the limit; only the sizes
    of at most `rows` + 1 rows come back.
    """
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("bigint") for c in df.columns]
    found = df.select(reduce(lambda a, b: a + b, text).alias("size")).take(rows + 1)
    return len(found) <= rows and sum(r["size"] for r in found) <= size


def with_statistics(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Add whole-frame aggregates to every row: a one-row table, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggregates.items()])))


def with_group_statistics(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Add per-key aggregates to every row.

    Partial aggregation shrinks a hot key before the shuffle, and the join back is
    one adaptive execution can split, unlike a window over the key.
    """
    return join_back(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), keys)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs. The right side is broadcast only when its row count is checked."""
    return left.crossJoin(F.broadcast(right) if bounded(right) else right)


def outer_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Left, right or full join on one shared column, safe for a hot key on either side.

    Adaptive execution can split both sides of an inner join but not the null-supplying
    side of an outer one. So rows with a partner come from an inner join, the others
    from an anti join against the distinct keys of the other side.
    """
    out = left.join(right, key, "inner")
    if how in ("left", "full"):
        out = out.unionByName(left.join(right.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    if how in ("right", "full"):
        out = out.unionByName(right.join(left.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def full_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, coalesce: bool = False) -> DataFrame:
    """Full join with both key columns, or with one where `coalesce` is set."""
    if coalesce:
        return outer_join(left, right.withColumnRenamed(right_key, left_key), left_key, "full")
    name = right_key if right_key != left_key else f"{right_key}_right"
    other = right.withColumnRenamed(right_key, name).withColumn("_k", F.col(f"`{name}`"))
    return outer_join(left.withColumn("_k", F.col(f"`{left_key}`")), other, "_k", "full").drop("_k")


def as_of(
    left: DataFrame, right: DataFrame, on: str, values: list[str], by: list[str], *,
    tie: str | None = None, within: int | None = None, matched_on: str | None = None,
) -> DataFrame:
    """Each left row with the last right row at or before it, per `by` key.

    `within` is the largest allowed gap (both ends in), in microseconds for
    timestamps and in units of the column otherwise. The right side first shrinks to
    one row per key and time. Both sides then run as one ordered scan in value-range
    buckets, so a hot key spreads over tasks. Left rows of one instant may be cut
    anywhere, as they bring no values: their hash serves as the tie.
    """
    picked = [*values] + ([] if on in values else [on])
    packed = F.struct(*[F.col(f"`{c}`") for c in picked])
    latest = right.groupBy(*by, on).agg(
        (F.max_by(packed, F.col(f"`{tie}`")) if tie else F.max(packed)).alias("_match"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    probe = left.select(*by, on, row.alias("_row"), F.lit(None).cast(latest.schema["_match"].dataType).alias("_match"),
                        (F.pmod(F.xxhash64(row), F.lit(1 << 20)) + 1).alias("_tie"))
    base = latest.select(*by, on, F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), "_match",
                         F.lit(0).cast("bigint").alias("_tie"))
    times = probe.select(on, "_tie").union(right.select(on, F.lit(0).cast("bigint").alias("_tie")))
    both = with_order_bucket(probe.unionByName(base).where(F.col(f"`{on}`").isNotNull()), on, "_tie", bounds_from=times)
    scanned = fill(both, {"_last": "_match"}, on, "_tie", by, bucketed=True)
    found = scanned.where("_row is not null").select("_row", "_last")
    # Null keys never match; null times were left out of the scan.
    keyed = reduce(lambda a, b: a & b, [F.col(f"_row.{k}").isNotNull() for k in by], F.lit(True))
    ok = keyed
    if within is not None:
        gap = _gap(left, on, F.col(f"_row.{on}"), F.col(f"_last.{on}"))
        ok = ok & (gap <= within)
    found = found.withColumn("_last", F.when(ok, F.col("_last")))
    extra = [F.col(f"_last.{on}").alias(matched_on)] if matched_on else []
    out = found.select("_row.*", *[F.col(f"_last.{v}") for v in values], *extra)
    untimed = left.where(F.col(f"`{on}`").isNull())
    return out.unionByName(untimed, allowMissingColumns=True) if left.schema[on].nullable else out


def _gap(df: DataFrame, on: str, late: Column, early: Column) -> Column:
    kind = df.schema[on].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))
    if kind == "date":
        return F.datediff(late, early)
    return late - early


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, *, width: float) -> DataFrame:
    """Pairs with low < at <= high, for two large sides.

    The line is cut into cells of `width` and, level by level, of twice the width. A span
    is listed in the at most three cells it touches on the level of its length; a point
    probes its cell on each level that spans are on (bounded by the exponents of a
    double). Spans without an end are on a level of one cell. Both sides meet by an equi
    join on level and cell; a cell that holds many rows of a side has that side cut into
    salts and the other side repeated for each.
    """
    a, b = F.col(f"`{low}`").cast("double"), F.col(f"`{high}`").cast("double")
    length = (b - a) / F.lit(float(width))
    endless = length == float("inf")
    level = F.when(endless, F.lit(WHOLE)).when(length <= 1, F.lit(0)).otherwise(F.ceil(F.log2(length)).cast("int"))
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda v: F.when(F.col("_level") == WHOLE, F.lit(0.0)).otherwise(F.floor(v / size).cast("double"))
    right = spans.where(F.col(f"`{low}`") <= F.col(f"`{high}`")).withColumn("_level", level)
    touched = F.filter(F.array_distinct(F.array(cell(a), cell(a) + 1, cell(a) + 2)), lambda c: c <= cell(b))
    levels = sorted(r["_level"] for r in right.select("_level").distinct().collect())
    right = right.withColumn("_cell", F.explode(touched)).withColumn("_cell", F.struct("_level", "_cell")).drop("_level")
    left = points.where(F.col(f"`{at}`").isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    left = left.withColumn("_cell", F.struct("_level", cell(F.col(f"`{at}`").cast("double")).alias("_cell"))).drop("_level")
    hot_left, hot_right = _hot_cells(left), _hot_cells(right)
    met = _salted(left, hot_left, hot_right, "_a", "_b", points.columns).join(
        _salted(right, hot_right, hot_left, "_b", "_a", spans.columns), ["_cell", "_a", "_b"], "inner")
    return met.where((F.col(f"`{at}`") > F.col(f"`{low}`")) & (F.col(f"`{at}`") <= F.col(f"`{high}`"))).drop("_cell", "_a", "_b")


def _hot_cells(side: DataFrame) -> DataFrame:
    """Cells with more than their share of a side's rows, and the salts each needs.

    At most `parts` cells can hold more than 1/parts of the rows: the table is small
    enough to broadcast by its definition.
    """
    parts = min(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1024)
    sizes = side.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    hot = sizes.crossJoin(F.broadcast(total)).where(F.col("_n") * parts > F.col("_total"))
    return hot.select("_cell", F.ceil(F.col("_n") * parts / F.col("_total")).cast("int").alias("_k"))


def _salted(side: DataFrame, own: DataFrame, other: DataFrame, salt: str, copies: str, columns: list[str]) -> DataFrame:
    """Give each row one of the salts of its cell, and a copy per salt of the other side."""
    own, other = own.withColumnRenamed("_k", "_own"), other.withColumnRenamed("_k", "_other")
    wide = side.join(F.broadcast(own), "_cell", "left").join(F.broadcast(other), "_cell", "left")
    hashed = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.coalesce("_own", F.lit(1))).cast("int")
    copied = F.explode(F.sequence(F.lit(0), F.coalesce("_other", F.lit(1)) - 1))
    return wide.withColumn(salt, hashed).withColumn(copies, copied).drop("_own", "_other")


def join_where(left: DataFrame, right: DataFrame, test: Column) -> DataFrame:
    """Join on any predicate. One-sided bounds have a near-quadratic result whatever
    the plan; the right side is broadcast when its row count is checked."""
    return left.join(F.broadcast(right) if bounded(right) else right, test, "inner")
