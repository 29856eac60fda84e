"""Every registered query against its DuckDB form, on whole tables."""

import os

import pytest
from compare import compare, duck

from lumenframe.queries import ORACLES, QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = set()


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_each_query_has_its_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    said = compare(spark, con, key, ROOT, QUERIES, ORACLES)
    assert said.startswith("rows only" if key in ROWS_ONLY else "ok"), said


def test_sample_is_repeatable(spark):
    a, b = [[r[0] for r in QUERIES["sample_n"](spark, ROOT).collect()] for _ in range(2)]
    assert a == b and len(a) == 20


def test_queries_leave_no_views(spark):
    before = {t.name for t in spark.catalog.listTables()}
    for key in ("sql_register", "sql_cte", "sql_table_function", "sql_ctas", "sql_group_by"):
        QUERIES[key](spark, ROOT).count()
    assert {t.name for t in spark.catalog.listTables()} == before
