"""The physical plans: pushdown, pruning, no unkeyed windows over data, no pair plans."""

import os
import re

import pytest

from lumenframe.queries import QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["scan_parquet_pushdown"](spark, ROOT))
    assert "LessThan(o_orderkey,100)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_partition_filter_prunes_folders(spark):
    p = plan(QUERIES["scan_hive_dir"](spark, ROOT).where("o_orderstatus = 'F'"))
    assert re.search(r"PartitionFilters: \[isnotnull\(o_orderstatus", p)


def test_top_n_cuts_before_the_shuffle(spark):
    p = plan(QUERIES["top_n_per_group"](spark, ROOT))
    assert p.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(QUERIES["sort_limit"](spark, ROOT))


@pytest.mark.parametrize("key", ["join_inner", "join_left", "join_full", "join_semi", "join_anti", "join_non_equi", "join_asof_backward",
                                 "sum_over_key_const", "rank_dense", "is_duplicated", "window_group_to_rows", "reward_table", "window_join"])
def test_equi_plans(spark, key):
    p = plan(QUERIES[key](spark, ROOT))
    assert "CartesianProduct" not in p
    if key != "join_non_equi":
        assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("key", ["segment_markers", "snippet_stats", "detect_operations", "render_turns", "history_validate", "slugify",
                                 "list_entropy", "select_by_regex", "unpivot", "concat_vertical"])
def test_row_local_jobs_shuffle_nothing(spark, key):
    # Small test tables in one file are spread by a row key first; that is the only exchange.
    p = plan(QUERIES[key](spark, ROOT))
    assert len(re.findall(r"Exchange (?!hashpartitioning\(doc_id)", p)) == 0


def test_whole_frame_statistics_use_no_window(spark):
    for key in ("zscore_deviation", "select_exprs", "row_is_max_flag", "window_mean"):
        assert "Window" not in plan(QUERIES[key](spark, ROOT))
