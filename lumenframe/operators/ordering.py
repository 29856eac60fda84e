"""Order-dependent operators that never put a whole key into one task.

Rows are cut into buckets by value ranges of the order column. A bucket number is
a fixed expression of the row, so it is the same in every branch and every retry.
The ranges hold about equal numbers of rows, so however hot a key is, one
(key, bucket) group holds about one bucket of rows. Windows run inside a bucket;
a table with one row per (key, bucket) carries counts or last values across.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BUCKETS = 8192
BUCKET_ROWS = 1_000_000
TREE = 64
SAMPLE = 64
TEXT = 64
LONGEST = 4096
BUCKET = "_bucket"
KEY = "_key"


def _sortable(df: DataFrame, name: str) -> Column:
    """The order column as a number where one keeps the order, else unchanged."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    return c


def _draw(pairs: DataFrame, most: int, *order: Column) -> tuple[list, int]:
    """Up to `most` rows picked by chance, in order, and about how many rows there are: one read of the source.

    The rows with the smallest of uniform random numbers are picked, so the largest one picked tells how many there are."""
    picked = pairs.withColumn("_r", F.rand(7)).orderBy("_r").limit(most).orderBy(*order).collect()
    if len(picked) < most:
        return picked, len(picked)
    return picked, int(most / max(max(r["_r"] for r in picked), 1e-18))


def _cuts(df: DataFrame, order: str, tie: str | None, descending: bool, parts: int | None) -> list[tuple]:
    """Pairs of (order, tie) that cut the rows into about equal parts, from a sample of bounded size.

    They steer bucket sizes only: results do not depend on the sample. Of texts the first `TEXT` characters serve, so the sample
    is bounded in bytes too; where many rows share these, more is read (see `_longer`). Without a given number, parts grow
    with the rows, from the number of shuffle partitions on.
    """
    def narrow(name: str) -> Column:
        c = _sortable(df, name)
        return F.left(c, F.lit(TEXT)) if isinstance(df.schema[name].dataType, T.StringType) else c

    pair = df.select(narrow(order).alias("v"), (narrow(tie) if tie else F.lit(None).cast("int")).alias("t"))
    wanted = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    wanted = max(1, min(wanted, MAX_BUCKETS))
    sort = (F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last(), F.col("t").asc_nulls_last())
    found, rows = _draw(pair, SAMPLE * wanted, *sort)
    if parts is None and -(-rows // BUCKET_ROWS) > wanted:
        wanted = min(-(-rows // BUCKET_ROWS), MAX_BUCKETS)
        found, _ = _draw(pair, SAMPLE * wanted, *sort)
    if wanted < 2 or not found:
        return []
    pairs = [(r["v"], r["t"]) for r in found]
    if isinstance(df.schema[order].dataType, T.StringType):
        whole = df.select(F.col(f"`{order}`").alias("v"), (narrow(tie) if tie else F.lit(None).cast("int")).alias("t"))
        pairs = _longer(whole, pairs, descending, wanted)
    out = []
    for p in (pairs[i * len(pairs) // wanted] for i in range(1, wanted)):
        if not out or repr(p) != repr(out[-1]):
            out.append(p)
    return out


def _longer(whole: DataFrame, pairs: list[tuple], descending: bool, parts: int) -> list[tuple]:
    """A sample of text prefixes in which no cut-off prefix fills more than a part, as far as `LONGEST` characters tell.

    Of the rows with such a prefix, the least and the largest text show how far all of them agree; the characters after that are
    sampled instead. Texts that are equal as a whole stay equal, and are cut by the tie.
    """
    length = TEXT
    while length < LONGEST:
        shares: dict[str, int] = {}
        for v, _ in pairs:
            if v is not None and len(v) >= length:
                shares[v] = shares.get(v, 0) + 1
        # No more than `parts` of them, as each fills a part.
        heavy = sorted(v for v, n in shares.items() if n > max(len(pairs) // parts, 1))
        if not heavy:
            break
        spark = whole.sparkSession
        listed = F.broadcast(spark.createDataFrame([(v, len(v)) for v in heavy], "p string, n int"))
        v = F.col("v")
        # A row has one prefix of each length in the list.
        among = whole.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sorted({len(x) for x in heavy})]))).withColumn("p", F.left(v, F.col("n")))
        among = among.join(listed, ["p", "n"]).drop("n")
        ends = {r["p"]: (r["lo"], r["hi"]) for r in among.groupBy("p").agg(F.min(F.left(v, F.lit(LONGEST))).alias("lo"), F.max(F.left(v, F.lit(LONGEST))).alias("hi")).collect()}
        agree = {p: next((i for i, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi))) for p, (lo, hi) in ends.items()}
        until = F.broadcast(spark.createDataFrame([(p, n + TEXT) for p, n in agree.items()], "p string, n int"))
        longer = among.join(until, "p").select(F.left(v, F.col("n")).alias("v"), "t")
        drawn, _ = _draw(longer, sum(shares[v] for v in heavy), "v")
        kept = [p for p in pairs if p[0] not in ends]
        pairs = kept + [(r["v"], r["t"]) for r in drawn]
        number = lambda t: (t is None, t != t, 0 if t is None or t != t else t)
        pairs.sort(key=lambda p: number(p[1]))
        pairs.sort(key=lambda p: (p[0] is not None, p[0] or "") if descending else (p[0] is None, p[0] or ""), reverse=descending)
        length = min(n + TEXT for n in agree.values())
    return pairs


def _at_or_before(value: Column, tie: Column | None, cut: tuple, descending: bool) -> Column:
    """Whether a row comes at or before a cut in the wanted order, nulls last."""
    v, t = cut
    later = F.lit(True) if t is None or tie is None else F.coalesce(tie <= F.lit(t), F.lit(False))
    if v is None:
        return value.isNotNull() | later
    first = value > F.lit(v) if descending else value < F.lit(v)
    return F.coalesce(first | ((value == F.lit(v)) & later), F.lit(False))


def _position(value: Column, tie: Column | None, cuts: list[tuple], descending: bool) -> Column:
    """Number of cuts before the row: a binary search as nested CASE expressions, and
    with many cuts a short scan of the part it leads to."""
    def node(ends: list[tuple], lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_at_or_before(value, tie, ends[mid], descending), node(ends, lo, mid)).otherwise(node(ends, mid + 1, hi))

    if len(cuts) <= TREE:
        return node(cuts, 0, len(cuts))
    step = -(-len(cuts) // TREE)
    chunks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    chunk = node([x[-1] for x in chunks[:-1]], 0, len(chunks) - 1)
    row = F.struct(value.alias("v"), (tie if tie is not None else F.lit(0)).alias("t"))
    pairs = [F.array(*[F.struct(F.lit(v).alias("v"), F.lit(t).alias("t")) for v, t in x]) for x in chunks]

    def passed(cut: Column) -> Column:
        later = cut["t"].isNull() | F.coalesce(row["t"] <= cut["t"], F.lit(False)) if tie is not None else F.lit(True)
        first = row["v"] > cut["v"] if descending else row["v"] < cut["v"]
        at = F.when(cut["v"].isNull(), row["v"].isNotNull() | later).otherwise(F.coalesce(first | ((row["v"] == cut["v"]) & later), F.lit(False)))
        return ~at

    return chunk * F.lit(step) + F.size(F.filter(F.get(F.array(*pairs), chunk), passed))


def with_order_bucket(
    df: DataFrame, order: str, tie: str | None = None, *, descending: bool = False, parts: int | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Add the bucket number of each row, ascending with the wanted order, nulls last.

    Cuts are pairs of order and tie values, so a value that fills more than a bucket is
    cut further by the tie column, and there are at most `parts` buckets in all.
    `bounds_from` is a cheaper frame with about the same values, where this one is
    derived at a cost.
    """
    cuts = _cuts(df if bounds_from is None else bounds_from, order, tie, descending, parts)
    place = _position(_sortable(df, order), _sortable(df, tie) if tie else None, cuts, descending)
    return df.withColumn(BUCKET, place.cast("bigint"))


def join_back(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join on keys of which nulls also match; key columns come from the left."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"_r_{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    test = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, test, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def _sort_cols(order: str, tie: str | None, descending: bool) -> list[Column]:
    c = F.col(f"`{order}`")
    cols = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    if tie:
        cols.append(F.col(f"`{tie}`").asc_nulls_last())
    return cols


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add the key as one struct. Structs with nulls compare as equal, so windows and
    the join of the carried values share one shuffle on (key, bucket)."""
    return df.withColumn(KEY, F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_")))


def _across() -> Window:
    """Window over the table with one row per key and bucket. Without keys it has at
    most one row per bucket, so a single task sees a bounded number of rows."""
    return Window.partitionBy(KEY).orderBy(BUCKET)


def number_rows(
    df: DataFrame, name: str, order: str, tie: str | None = None, keys: list[str] | None = None, *,
    descending: bool = False, parts: int | None = None, bounds_from: DataFrame | None = None,
) -> DataFrame:
    """1-based row number per key in the given order."""
    b = keyed(with_order_bucket(df, order, tie, descending=descending, parts=parts, bounds_from=bounds_from), keys or [])
    before = _sums_before(b, F.count(F.lit(1)))
    local = Window.partitionBy(KEY, BUCKET).orderBy(*_sort_cols(order, tie, descending))
    out = b.withColumn(name, F.row_number().over(local).cast("bigint")).join(before, [KEY, BUCKET], "left")
    return out.withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0))).drop("_before", BUCKET, KEY)


def _sums_before(b: DataFrame, amount: Column) -> DataFrame:
    """For each key and bucket the sum of an amount over the earlier buckets."""
    sums = b.groupBy(KEY, BUCKET).agg(amount.alias("_n"))
    earlier = _across().rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(KEY, BUCKET, F.sum("_n").over(earlier).alias("_before"))


def running_total(df: DataFrame, name: str, value: str, order: str, tie: str | None = None,
                  keys: list[str] | None = None, *, descending: bool = False,
                  bounds_from: DataFrame | None = None) -> DataFrame:
    """Running sum of a whole-number column per key in the given order."""
    b = keyed(with_order_bucket(df, order, tie, descending=descending, bounds_from=bounds_from), keys or [])
    before = _sums_before(b, F.sum(value))
    local = (Window.partitionBy(KEY, BUCKET).orderBy(*_sort_cols(order, tie, descending))
             .rowsBetween(Window.unboundedPreceding, 0))
    out = b.withColumn(name, F.sum(value).over(local)).join(before, [KEY, BUCKET], "left")
    return out.withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0))).drop("_before", BUCKET, KEY)


def fill(
    df: DataFrame, forward: dict[str, str], order: str, tie: str | None = None, keys: list[str] | None = None, *,
    backward: dict[str, str] | None = None, bucketed: bool = False,
) -> DataFrame:
    """For each `target: source`, the last value so far (forward) or the next value
    (backward) that is not null, the row's own value included. `bucketed`: the frame
    has its bucket already, and keeps it."""
    backward = backward or {}
    b = keyed(df if bucketed else with_order_bucket(df, order, tie), keys or [])
    # Nulls come last, as in the windows.
    at = F.struct(*[x.alias(f"{i}{j}") for i, c in enumerate([order] + ([tie] if tie else [])) for j, x in enumerate((F.col(f"`{c}`").isNull(), F.col(f"`{c}`")))])
    # max_by and min_by skip rows of which the ordering value is null.
    where = lambda s: F.when(F.col(f"`{s}`").isNotNull(), at)
    ends = b.groupBy(KEY, BUCKET).agg(
        *[F.max_by(F.col(f"`{s}`"), where(s)).alias(f"_e_{t}") for t, s in forward.items()],
        *[F.min_by(F.col(f"`{s}`"), where(s)).alias(f"_e_{t}") for t, s in backward.items()])
    past, future = _across().rowsBetween(Window.unboundedPreceding, -1), _across().rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(
        KEY, BUCKET, *[F.last(f"_e_{t}", ignorenulls=True).over(past).alias(f"_c_{t}") for t in forward],
        *[F.first(f"_e_{t}", ignorenulls=True).over(future).alias(f"_c_{t}") for t in backward])
    local = Window.partitionBy(KEY, BUCKET).orderBy(*_sort_cols(order, tie, False))
    so_far, ahead = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(0, Window.unboundedFollowing)
    inside = b.select(
        "*", *[F.last(s, ignorenulls=True).over(so_far).alias(f"_l_{t}") for t, s in forward.items()],
        *[F.first(s, ignorenulls=True).over(ahead).alias(f"_l_{t}") for t, s in backward.items()])
    made = [*forward, *backward]
    out = inside.join(carry, [KEY, BUCKET], "left").withColumns({t: F.coalesce(F.col(f"_l_{t}"), F.col(f"_c_{t}")) for t in made})
    drop = [f"_l_{t}" for t in made] + [f"_c_{t}" for t in made]
    return out.drop(*drop, KEY) if bucketed else out.drop(*drop, KEY, BUCKET)


def interpolate(df: DataFrame, target: str, source: str, order: str, tie: str | None = None,
                keys: list[str] | None = None, *, forward: dict[str, str] | None = None,
                bounds_from: DataFrame | None = None) -> DataFrame:
    """Linear fill between known values by row position; outer nulls stay.

    `forward` fills more columns forward in the same scan. Positions inside a bucket
    become positions in the key by adding the rows of earlier buckets.
    """
    forward = forward or {}
    local = Window.partitionBy(KEY, BUCKET).orderBy(*_sort_cols(order, tie, False))
    placed = keyed(with_order_bucket(df, order, tie, bounds_from=bounds_from), keys or []).withColumn("_p", F.row_number().over(local).cast("bigint"))
    value = F.col(f"`{source}`")
    placed = placed.withColumn("_k", F.when(value.isNotNull(), F.struct(F.col("_p").alias("p"), value.cast("double").alias("v"))))
    ends = placed.groupBy(KEY, BUCKET).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_k").alias("_last"), F.min("_k").alias("_first"),
        *[F.max_by(F.col(f"`{s}`"), F.when(F.col(f"`{s}`").isNotNull(), F.col("_p"))).alias(f"_e_{t}") for t, s in forward.items()])
    past, future = _across().rowsBetween(Window.unboundedPreceding, -1), _across().rowsBetween(1, Window.unboundedFollowing)
    moved = lambda k: F.when(k.isNotNull(), F.struct((k["p"] + F.col("_before")).alias("p"), k["v"].alias("v")))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    ends = ends.withColumns({"_last": moved(F.col("_last")), "_first": moved(F.col("_first"))})
    carry = ends.select(
        KEY, BUCKET, "_before", F.last("_last", ignorenulls=True).over(past).alias("_c_prev"),
        F.first("_first", ignorenulls=True).over(future).alias("_c_next"),
        *[F.last(f"_e_{t}", ignorenulls=True).over(past).alias(f"_c_{t}") for t in forward])
    so_far, ahead = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(0, Window.unboundedFollowing)
    inside = placed.select(
        "*", F.last("_k", ignorenulls=True).over(so_far).alias("_l_prev"), F.first("_k", ignorenulls=True).over(ahead).alias("_l_next"),
        *[F.last(s, ignorenulls=True).over(so_far).alias(f"_l_{t}") for t, s in forward.items()])
    out = inside.join(carry, [KEY, BUCKET], "left").withColumns({
        "_prev": F.coalesce(moved(F.col("_l_prev")), F.col("_c_prev")), "_next": F.coalesce(moved(F.col("_l_next")), F.col("_c_next"))})
    a, b, pos = F.col("_prev"), F.col("_next"), F.col("_p") + F.col("_before")
    share = (pos - a["p"]).cast("double") / F.nullif(b["p"] - a["p"], F.lit(0)).cast("double")
    filled = {t: F.coalesce(F.col(f"_l_{t}"), F.col(f"_c_{t}")) for t in forward}
    out = out.withColumns({target: F.coalesce(value.cast("double"), a["v"] + (b["v"] - a["v"]) * share), **filled})
    return out.drop(BUCKET, KEY, "_p", "_k", "_before", "_prev", "_next", *[f"_{x}_{t}" for x in "lc" for t in ("prev", "next", *forward)])


def rank_values(df: DataFrame, name: str, keys: list[str], by: list[str], *, method: str = "dense",
                descending: bool = False) -> DataFrame:
    """Rank per key: ties share a rank, a null value gets none.

    Ranks depend on distinct values only, so copies are counted before any
    ordering and the ranks are joined back.
    """
    usable = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in by])
    distinct = df.where(usable).groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("_n"))
    order, tie = by[0], (by[1] if len(by) > 1 else None)
    if len(by) > 2:
        raise ValueError("rank by one or two columns")
    if tie and descending:
        ranked = _rank_pairs_descending(distinct, df, name, keys, order, tie, method)
    elif method == "dense":
        ranked = number_rows(distinct, name, order, tie, keys, descending=descending, bounds_from=df)
    else:
        ranked = running_total(distinct, name, "_n", order, tie, keys, descending=descending, bounds_from=df)
        ranked = ranked.withColumn(name, F.col(name) - F.col("_n") + 1)
    return join_back(df, ranked.drop("_n"), [*keys, *by])


def _rank_pairs_descending(distinct, df, name, keys, order, tie, method):
    """Descending on both columns: the ascending position counted from the end."""
    up = number_rows(distinct, name, order, tie, keys, bounds_from=df) if method == "dense" else running_total(
        distinct, name, "_n", order, tie, keys, bounds_from=df)
    total = distinct.groupBy(*keys).agg((F.count(F.lit(1)) if method == "dense" else F.sum("_n")).alias("_total"))
    joined = join_back(up, total, keys) if keys else up.crossJoin(F.broadcast(total))
    return joined.withColumn(name, F.col("_total") - F.col(name) + 1).drop("_total")
