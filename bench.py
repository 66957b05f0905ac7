"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores (default 8). Every
query is planned and run to its last row; the time of a query is the better of two runs, so that it is
not the time of starting the JVM or the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from steadymark import build_session
from steadymark.catalog.queries import all_queries

HEADLINE = (
    "joined_fact",
    "base_stats",
    "degradation",
    "global_profile",
    "adapter_summary",
    "feature_separation",
    "correlations",
    "spearman",
    "roc_auc",
    "permuted_column",
    "silver_metrics",
    "ood_outcomes",
    "batch_score_python",
    "batch_explain_python",
    "robustness_end_to_end",
)
RUNS = 2


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    seconds = {name: round(min(run(registered[name], spark, sf_dir) for _ in range(RUNS)), 3) for name in wanted}
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
