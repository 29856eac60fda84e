"""Every registered query at the smallest size, against its SQL where there is one."""

import importlib.util
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry
from compare import compare, duck

from lumenframe.llm import ORACLES, QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_each_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_against_sql(spark, key):
    assert compare(spark, duck(ROOT), key, ROOT, QUERIES, ORACLES).startswith("ok")


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, key):
    assert QUERIES[key](spark, ROOT).count() > 0


def test_nothing_else_imports_the_subpackage():
    root = Path(importlib.util.find_spec("lumenframe").origin).parent
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if "llm" in p.read_text()]
