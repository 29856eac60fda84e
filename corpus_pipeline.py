"""A training corpus from `documents`: language ID, line dedup, near-duplicate documents, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it to the shared folder and reads
it again as the next stage's docs. All stages but the last return the columns of `documents`. Each sets a bound to
the bytes of the batches that Python gets, which stays set while the caller writes its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.bpe import default_vocabulary, encode_rows
from lumenframe.llm.decontaminate import with_leaks
from lumenframe.llm.jaccard_join import similar_documents
from lumenframe.llm.language_id import learn, with_language
from lumenframe.llm.line_dedup import drop_repeated_lines
from lumenframe.session import prepare, scratch_dir, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter go."""
    small_batches(spark)
    done = with_language(spark, docs.withColumn("_text", F.col("text")), learn(docs.select("lang", "text")), "_text")
    return done.where("lang_pred <> 'und'").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest document only; n_chars follows."""
    done = drop_repeated_lines(small_batches(spark), docs)
    return done.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies stays."""
    others = similar_documents(small_batches(spark), docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    # Written first, so that Spark knows their size: ids below its limit for broadcasts spare a shuffle of the texts.
    others.write.parquet(path := scratch_dir(spark, "near-copies"))
    return docs.join(spark.read.schema(others.schema).parquet(path), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark stay."""
    benchmark = small_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_leaks(spark, docs, benchmark).where(F.size("leaks") == 0).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids (32-bit little-endian, binary) and their decoded text's hash."""
    done = encode_rows(small_batches(spark), docs, default_vocabulary(), digest=True)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("token_ids", token_ids)]

#: Language models and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
