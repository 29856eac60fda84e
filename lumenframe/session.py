"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20


def build_session(app: str = "lumenframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Run-time settings needed for right results on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Batches of rows for Python hold about `BATCH_BYTES`, however long the texts are, or one row.

    Spark's default is 10,000 rows, which a task holds several times: as rows, as Arrow buffers
    and in its Python worker. What these grow to stays with the executor for later stages.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "").startswith("local")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, below the one named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="lumenframe-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def table(spark: SparkSession, root: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A table of the data folder.

    `spread_by`: before heavy work on long texts, a table read by fewer tasks than there
    are cores is spread over all of them by a row key. That holds for small tables only;
    larger ones are read by more tasks and left as they are.
    """
    df = spark.read.parquet(f"{root}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread_by and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, spread_by)
    return df
