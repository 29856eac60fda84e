"""A finite query run by the streaming engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir


FANOUT = 8


class Versions:
    """Changed groups of each micro-batch as tables of rows with a version; the newest row of a key counts.

    Tables are merged when `FANOUT` of one size class are there, so a row is written again as often as the number of batches has
    digits in base `FANOUT`, and the result is read from few tables. Names follow from the batch number alone: a batch that runs
    again after a failure replaces its own tables.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder, keys
        self.classes: list[list[str]] = [[]]

    def newest(self, tables: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*tables)
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), F.col("_version")).alias("_row")).select("_row.*")

    def add(self, changed: DataFrame, number: int) -> None:
        path = f"{self.folder}/class=0-batch={number}"
        if path in self.classes[0]:
            self.classes[0].remove(path)
        changed.withColumn("_version", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(path)
        self.classes[0].append(path)
        level = 0
        while len(self.classes[level]) >= FANOUT:
            merged, old = f"{self.folder}/class={level + 1}-batch={number}", self.classes[level]
            self.newest(old).write.mode("overwrite").parquet(merged)
            if level + 1 == len(self.classes):
                self.classes.append([])
            self.classes[level], self.classes[level + 1] = [], [*self.classes[level + 1], merged]
            for path in old:  # all of it is in the merged table
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            level += 1

    def result(self) -> DataFrame | None:
        tables = [t for level in self.classes for t in level]
        return self.newest(tables).drop("_version") if tables else None


def run_once(spark: SparkSession, path: str, schema: T.StructType, aggregate: Callable[[DataFrame], DataFrame], keys: list[str], *,
             files_per_batch: int | None = None) -> DataFrame:
    """Read all files now at the path (a folder or one file) as a stream, aggregate by `keys`, and return the result.

    State is one row per group. Each micro-batch writes only the groups that it touches (see `Versions`); the
    result is the newest version of each. `files_per_batch` cuts the input into micro-batches.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # A stream reads folders: one file is its folder with a filter on the name.
        source = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    else:
        source = reader.parquet(path)
    out = scratch_dir(spark, "stream")
    versions = Versions(spark, f"{out}/result", keys)
    run = (aggregate(source).writeStream.outputMode("update").queryName(f"bounded_{uuid.uuid4().hex[:8]}")
           .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(versions.add).start())
    run.awaitTermination()
    found = versions.result()
    # No file: the aggregate of nothing.
    return aggregate(spark.createDataFrame([], schema)) if found is None else found
