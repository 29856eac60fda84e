"""The pipeline's stages, each on its own input."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipe
from rows import empty, odd

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    assert [n for n, _ in pipe.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "token_ids"] and pipe.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    near = {r["doc_id"] for r in pipe.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t, i)
    assert near <= set(first.values()) and len(near) < len(texts)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in pipe.decontamination(spark, docs, SF).collect()}
    assert clean == {i for i, t in texts.items() if not any(x in " ".join(t.lower().split()) for x in items)}
    lines = {r["doc_id"]: r for r in pipe.line_dedup(spark, docs, SF).collect()}
    assert set(lines) == set(texts) and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    for name, stage in pipe.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipe.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), stage(spark, docs, SF).schema)
    want = sorted((r["doc_id"], bytes(r["ids"])) for r in docs.collect())
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in pipe.run(spark, SF).collect())
    assert got == want and all(r["n_tokens"] * 4 == len(r["ids"]) for r in docs.collect()) and np.frombuffer(got[0][1], "<u4").max() < 50257


def test_stages_take_odd_rows(spark):
    for rows in (odd(spark), empty(spark)):
        docs = rows.selectExpr("doc_id", "text", "source AS lang", "source", "1L AS n_chars", "id", "spans", "leaks", "kept")
        for name, stage in pipe.STAGES:
            made = stage(spark, docs, SF)
            assert made.count() <= docs.count(), name


def test_components_run_in_small_plans(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from lumenframe.llm.components import components
    plans, write = [], DataFrameWriter.parquet

    def kept(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (60, 59), (61, 60), (60, 61)]
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {60: 59, 61: 59}
    # The driver holds each plan with its generated code, hash tables and threads: no step reads its input more than twice.
    assert plans and all(p.count("Relation [") <= 2 for p in plans)


def test_near_duplicates_leaves_texts_where_they_are(spark):
    docs, limit = spark.read.parquet(f"{SF}/documents.parquet"), "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(limit)
    spark.conf.set(limit, "20000")
    try:
        done = pipe.near_duplicates(spark, docs, SF)
        plan = done._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert 0 < done.count() < docs.count()
    finally:
        spark.conf.set(limit, usual)


def test_stages_bound_the_batches_of_python(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [sum(len(t.as_py()) for t in b.column(0))]})

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual, size = spark.conf.get(limit), 1 << 20
    texts = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), size).alias("text"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    try:
        for name, stage in pipe.STAGES:
            spark.conf.set(limit, usual)
            stage(spark, docs, SF)
            got = texts.mapInArrow(seen, "rows bigint, bytes bigint").collect()
            assert sum(r["rows"] for r in got) == 24 and max(r["bytes"] for r in got) <= 6 * size, name
    finally:
        spark.conf.set(limit, usual)
