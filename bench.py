"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_REPEAT (default 3, the median counts) set the run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from assayer.session import local_session  # noqa: E402
from queries import catalog  # noqa: E402

HEADLINE = (
    "q_count", "q_avg_by", "sql_join_inner", "missing_by_column", "duplicate_rows", "rare_categories",
    "identifier_dups", "iqr_outliers_lineitem", "suspicious_rows", "quality_score", "validity", "consistency",
    "schema_profile_orders", "text_length_profile", "clean_result", "numeric_profile", "categorical_profile",
    "correlations", "category_numeric_effect", "cramers_v", "time_trend", "histogram_lineitem", "box_by_group",
    "statistical_findings",
)
#: Whole plans of many queries each; run once.
PLANS = ("automatic_charts", "score_delta", "prepared_bundle")


def run(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")), "16g")
    run("q_avg_by", spark, sf_dir)
    times = {n: round(statistics.median(run(n, spark, sf_dir) for _ in range(repeat)), 3) for n in HEADLINE}
    times |= {n: round(run(n, spark, sf_dir), 3) for n in PLANS}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec",
        "queries": times, "sf": float(scale[1]) if scale else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
