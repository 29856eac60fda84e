"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: a, b. One row (node, root) per linked node but the root, the smallest node of its component.

    Each half step is written to the shared folder, so a lost executor costs one of them, and plans stay small: the driver
    keeps plans, generated code and a thread for each shuffle of a query. Minima are aggregated before they are joined back,
    and that join can be split where one node has very many links. Both sides are shuffled by then, so a broadcast would save
    nothing and leave a hash table of each step on the driver.
    """
    def stored(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "links")
        df.distinct().write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def state_of(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    def pair(u: str, v: str):
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    state = state_of(edges)
    while state[0]:
        both = edges.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Where v is the least itself, both rows are the same one.
        edges = stored(large.join(least.hint("merge"), "u").select(F.inline(F.array(pair("u", "m"), F.struct(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))))))
        new = state_of(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
