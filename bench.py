"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local threads. Each query
writes its whole result to the no-op sink; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lumenframe.queries import QUERIES
from lumenframe.session import build_session

HEADLINE = [
    "group_by_agg", "scan_parquet_pushdown", "with_columns", "zscore_deviation", "join_inner", "join_left", "join_non_equi",
    "join_asof_backward", "agg_collect_list", "n_unique", "describe", "sum_over_key_const", "rank_dense", "top_n_per_group",
    "fill_forward_backward", "interpolate_linear", "window_group_to_rows", "with_row_index", "sort", "pivot_static", "unpivot",
    "explode", "list_entropy", "str_extract_all", "group_by_dynamic_month", "upsample_ffill", "sql_cte", "bounded_stream",
    "udf_grouped", "segment_markers", "snippet_record", "detect_operations", "build_message", "pairs_split", "schema_prompt",
    "sft_formats", "reward_table", "struct_rank", "rank_agg_explode", "window_join", "upsample_interpolate", "text_encoding_fallback",
]
# Ordered scans once more with the default number of shuffle partitions; shown with a suffix.
MANY = ["fill_forward_backward", "join_asof_backward"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [(k, cpus) for k in sys.argv[1:] or HEADLINE] + [(k, "200") for k in ([] if sys.argv[1:] else MANY)]
    spent = {}
    for key, partitions in wanted:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        spent[key if partitions == cpus else f"{key}_{partitions}"] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
