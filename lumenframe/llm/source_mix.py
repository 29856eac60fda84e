"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code-point order (a null one last) weigh 1, 2, 3 and so on in turns, and share the words of the whole
corpus; a target stops at `most` times its source's size, and the excess is shared again by weight.

Seats: the corpus has words / `block` seats of equal size. They go to the sources by the highest quotients target / (2k - 1),
k = 1, 2, …. A source's words lie in one seeded order of its documents, cut into blocks of nearly `block` words (equal within a
source), and its blocks into shards of up to `shard` blocks. The source's seats go to its shards by highest quotients too.
A shard with q seats for m blocks takes all of them q div m times, and a run of q mod m blocks, from a seeded start and
around the end, once more. So documents are cut at the ends of a run only, and nothing is taken more than `most` times.

Quotients are not listed in full: with n seats and p parties of weight w, out of W in all, the last winning quotient lies between
W / (n + p/2) and W / (n - p/2); seats above that range are given at once, and only the quotients inside it, about two per party,
are ranked. Totals, targets, places in the order, quotients and quotas are Spark tables; the driver sees single totals.
Running totals and ranks are cut into buckets by ranges of their order, so a source that holds a third of all rows is spread.

Defined results: a null or empty text, or one of white space only, has size 0, takes 0 and has no pieces; rows are not merged,
so repeated rows each have a place; rows with equal id and size may change places, which no result shows; a null id is a value
like others; an empty table gives no rows; other columns are not looked at. `mixed_texts` needs distinct ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import join_back, number_rows, running_total
from ..session import scratch_dir
from .registry import query, read

BLOCK = 8
SHARD = 8192
MOST = 3
SEED = 12
WORD = r"[^\x20\x09-\x0D]++"


def seeded(*parts: Column, seed: int) -> Column:
    """60 bits of the MD5 of the parts, as a number: the same in every run and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _stored(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def source_targets(spark: SparkSession, sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Each round raises the words per weight to what the sources below their bound share; it ends once no further source is bound,
    and only one row of totals per round comes to the driver."""
    turn = (F.col("nth") - 1) % 3 + 1
    named = number_rows(sizes, "nth", "source").withColumn("weight", turn)
    named = _stored(spark, "sources", named.select("source", "source_size", "weight"))
    total = int(named.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"])
    share, weights, bound = total, 0, -1
    while True:
        # Whole-number comparison of most * size with weight * share / weights.
        full = F.lit(False) if not weights else (
            F.col("source_size").cast("decimal(38,0)") * (most * weights) <= F.col("weight").cast("decimal(38,0)") * F.lit(share).cast("decimal(24,0)"))
        now = named.agg(F.count(F.when(full, 1)).alias("bound"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("words"),
                        F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weights")).first()
        if now["bound"] == bound:
            break
        bound, share, weights = now["bound"], total - most * int(now["words"]), int(now["weights"])
        if not weights:
            full = F.lit(True)
            break
    part = (F.col("weight") * F.lit(share)).cast("double") / F.lit(float(max(weights, 1)))
    return named.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(part))


def apportion(spark: SparkSession, parties: DataFrame, party: str, weight: str, seats: DataFrame, keys: list[str]) -> DataFrame:
    """Seats by Sainte-Laguë: the highest quotients weight / (2k - 1), equal ones to the smaller party.

    parties: keys, party, weight (a double above 0). seats: keys, seats. Adds quota to the parties of each key."""
    totals = parties.groupBy(*keys).agg(F.sum(weight).alias("_all"), F.count(F.lit(1)).alias("_parties"))
    one = F.lit(0).alias("_one")
    totals = join_back(totals, seats, keys) if keys else totals.select("*", one).join(seats.select("*", one), "_one").drop("_one")
    held = join_back(parties, totals, keys) if keys else parties.select("*", one).join(totals.select("*", one), "_one").drop("_one")
    w, n, half = F.col(weight), F.col("seats"), F.col("_parties") / 2
    # One seat more on both sides than the bounds say, against rounding.
    sure = F.greatest(F.floor(w * (n - half) / F.col("_all") + 0.5) - 2, F.lit(0)).cast("bigint")
    last = (F.floor(w * (n + half) / F.col("_all") + 0.5) + 2).cast("bigint")
    held = _stored(spark, "parties", held.withColumns({"_sure": sure, "_last": last}))
    open_ = held.select(*keys, party, w.alias("_w"), F.explode(F.sequence(F.col("_sure") + 1, F.col("_last"))).alias("_k"))
    open_ = open_.withColumn("_quotient", F.col("_w") / (2 * F.col("_k") - 1).cast("double"))
    ranked = number_rows(open_, "_nth", "_quotient", party, keys, descending=True)
    left = held.groupBy(*keys).agg((F.first("seats") - F.sum("_sure")).alias("_left"))
    ranked = join_back(ranked, left, keys) if keys else ranked.select("*", one).join(left.select("*", one), "_one").drop("_one")
    won = ranked.where(F.col("_nth") <= F.col("_left")).groupBy(*keys, party).agg(F.count(F.lit(1)).alias("_won"))
    return join_back(held, won, [*keys, party]).withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop(
        "_all", "_parties", "_sure", "_last", "_won", "seats")


def _overlap(first: Column, last: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(last, high) - F.greatest(first, low), F.lit(0))


def mix(spark: SparkSession, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and pieces per document: which words of its text
    are taken how often, as first (from 0), words and times, in text order and without overlap; words in no piece are not taken."""
    rows = _stored(spark, "sizes", docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(F.col("text"), F.lit(WORD)).cast("bigint").alias("size"))
                   .withColumn("size", F.coalesce("size", F.lit(0))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(spark, sizes, most)

    blocks = F.greatest(F.expr(f"(2 * source_size + {block}) div {2 * block}"), F.lit(1))
    sources = _stored(spark, "targets", targets.withColumns({"blocks": blocks, "shards": F.ceil(blocks / shard).cast("bigint")}))
    usable = sources.where("target > 0")
    seats = usable.agg(F.expr(f"(2 * sum(source_size) + {block}) div {2 * block}").alias("seats"))
    quotas = apportion(spark, usable, "source", "target", seats, []).withColumn("quota", F.least("quota", F.col("blocks") * most))
    shards = quotas.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    shards = shards.withColumn("m", F.least(F.col("blocks") - F.col("shard") * shard, F.lit(shard)))
    shards = _stored(spark, "shards", shards.select("source", "source_size", "blocks", "shard", "m", F.col("quota").alias("of_source"), F.col("m").cast("double").alias("w")))
    given = apportion(spark, shards.select("source", "shard", "w"), "shard", "w", shards.where("shard = 0").select("source", F.col("of_source").alias("seats")), ["source"])
    shards = join_back(shards, given.select("source", "shard", "quota"), ["source", "shard"])
    # A block starts at word floor(number * source_size / blocks) of its source.
    at = lambda b: F.floor(b.cast("decimal(38,0)") * F.col("source_size") / F.col("blocks")).cast("bigint")
    base, more = F.floor(F.col("quota") / F.col("m")), F.col("quota") % F.col("m")
    start = F.pmod(seeded(F.col("source"), F.col("shard"), seed=seed), F.col("m"))
    first = F.col("shard") * shard
    shards = shards.select(
        "source", "shard", base.alias("times"), at(first).alias("from"), at(first + F.col("m")).alias("to"),
        at(first + start).alias("run"), at(first + F.least(start + more, F.col("m"))).alias("run_end"),
        at(first).alias("wrap"), at(first + F.greatest(start + more - F.col("m"), F.lit(0))).alias("wrap_end"))

    # Each document's place among its source's words, and the shards it lies in.
    placed = rows.where("size > 0").withColumn("_order", seeded(F.col("doc_id"), F.col("size"), seed=seed))
    placed = running_total(placed, "end", "size", "_order", "doc_id", ["source"], bounds_from=placed.select("_order", "doc_id"))
    placed = join_back(placed, sources.select("source", "source_size", "target", "blocks"), ["source"])
    placed = placed.withColumn("begin", F.col("end") - F.col("size"))
    holding = lambda p: F.floor(F.floor(((p + 1).cast("decimal(38,0)") * F.col("blocks") - 1) / F.col("source_size")) / shard).cast("bigint")
    spread = placed.withColumn("shard", F.explode(F.sequence(holding(F.col("begin")), holding(F.col("end") - 1))))
    spread = spread.select("doc_id", "size", "source", "source_size", "target", "begin", "end", "shard")
    found = join_back(spread, shards, ["source", "shard"])
    low, high = F.greatest("begin", "from"), F.least("end", "to")
    taken = (high - low) * F.col("times") + _overlap(low, high, F.col("run"), F.col("run_end")) + _overlap(low, high, F.col("wrap"), F.col("wrap_end"))
    cuts = F.array_sort(F.array_distinct(F.array(low, high, *[F.least(F.greatest(F.col(c), low), high) for c in ("run", "run_end", "wrap", "wrap_end")])))
    inside = lambda x: ((x >= F.col("run")) & (x < F.col("run_end"))) | ((x >= F.col("wrap")) & (x < F.col("wrap_end")))
    pieces = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda x, i: F.struct(
        (x - F.col("begin")).alias("first"), (F.element_at(cuts, i + 2) - x).alias("words"), (F.col("times") + F.when(inside(x), 1).otherwise(0)).alias("times")))
    found = found.withColumns({"taken": taken, "pieces": F.filter(pieces, lambda p: p["times"] > 0)})
    whole = found.groupBy("doc_id", "source", "begin", "end").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"),
        F.array_sort(F.flatten(F.collect_list("pieces"))).alias("pieces"))
    none = F.lit(None).cast(whole.schema["pieces"].dataType)
    empty = join_back(rows.where("size = 0"), sources.select("source", "source_size", "target"), ["source"]).withColumns(
        {"taken": F.lit(0).cast("bigint"), "pieces": F.coalesce(none, F.array())})
    made = ["doc_id", "source", "size", "source_size", "target", "taken", "pieces"]
    return whole.select(made).unionByName(empty.select(made))


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """doc_id, source, text, words: each piece as often as the mix takes it, its words joined by one space."""
    joined = mixed.where("taken > 0").join(docs.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words")), "doc_id")
    pieces = joined.select("doc_id", "source", "_words", F.explode("pieces").alias("p"))
    repeated = pieces.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("p.times").cast("int"))))
    text = F.array_join(F.slice("_words", (F.col("p.first") + 1).cast("int"), F.col("p.words").cast("int")), " ")
    return repeated.select("doc_id", "source", text.alias("text"), F.col("p.words").alias("words"))


@query("op12_source_mix", """
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM rows GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS words, CAST(sum(weight) AS BIGINT) AS weights FROM sources),
-- Sources in the order in which they fill up; the words and weights of those before each.
filling AS (
  SELECT *, coalesce(sum(source_size) OVER w, 0) AS words_before, coalesce(sum(weight) OVER w, 0) AS weights_before
  FROM sources WINDOW w AS (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full_ones AS (
  SELECT f.*, 3 * CAST(source_size AS HUGEINT) * (t.weights - weights_before) <= weight * (t.words - 3 * words_before) AS is_full
  FROM filling f, total t),
free AS (
  SELECT CAST(any_value(t.words) - 3 * coalesce(sum(source_size) FILTER (is_full), 0) AS BIGINT) AS words,
    CAST(coalesce(sum(weight) FILTER (NOT is_full), 0) AS BIGINT) AS weights FROM full_ones, total t),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
      ELSE CAST(weight * free.words AS DOUBLE) / CAST(free.weights AS DOUBLE) END AS target,
    greatest((2 * source_size + 8) // 16, 1) AS blocks FROM full_ones, free),
seats AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST) AS nth
  FROM (SELECT source, target, unnest(range(1, 3 * blocks + 3)) AS k FROM targets WHERE target > 0)),
quotas AS (
  SELECT t.source, any_value(t.source_size) AS source_size, any_value(t.blocks) AS blocks,
    least(count(s.nth) FILTER (s.nth <= (2 * total.words + 8) // 16), 3 * any_value(t.blocks)) AS quota
  FROM total, targets t JOIN seats s ON t.source IS NOT DISTINCT FROM s.source GROUP BY t.source),
shards AS (
  SELECT *, least(blocks - shard * 8192, 8192) AS m
  FROM (SELECT *, unnest(range(0, CAST(ceil(blocks / 8192) AS BIGINT))) AS shard FROM quotas)),
shard_seats AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CAST(m AS DOUBLE) / (2 * k - 1) DESC, shard) AS nth
  FROM (SELECT *, unnest(range(1, 3 * m + 2)) AS k FROM shards)),
shard_quotas AS (
  SELECT source, source_size, blocks, shard, m, count(*) FILTER (nth <= quota) AS q,
    CAST('0x' || substr(md5('12:' || coalesce(source, '') || ':' || shard), 1, 15) AS BIGINT) % m AS start
  FROM shard_seats GROUP BY ALL),
block_times AS (
  SELECT source, (shard * 8192 + b) * CAST(source_size AS HUGEINT) // blocks AS low,
    (shard * 8192 + b + 1) * CAST(source_size AS HUGEINT) // blocks AS high,
    q // m + CASE WHEN (b - start + m) % m < q % m THEN 1 ELSE 0 END AS times
  FROM (SELECT *, unnest(range(0, m)) AS b FROM shard_quotas)),
placed AS (
  SELECT row_number() OVER () AS id, *, sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5(
    '12:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 15) AS BIGINT), doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS last
  FROM rows),
taken AS (
  SELECT p.id, CAST(sum((least(p.last, b.high) - greatest(p.last - p.size, b.low)) * b.times) AS BIGINT) AS taken
  FROM placed p JOIN block_times b ON p.source IS NOT DISTINCT FROM b.source AND b.low < p.last AND b.high > p.last - p.size
  WHERE p.size > 0 GROUP BY p.id)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON k.id = p.id""")
def op12(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents").select("doc_id", "source", "text")
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")
