"""Benchmark the headline queries.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full with the ``noop`` sink (every row produced,
nothing collected). One untimed warm-up pass of every headline query on
sf0.001 first loads and JIT-compiles the JVM code paths (generated classes are
cached per plan), so the timings are steady-state execution, not compilation.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "clean_a",
    "clean_b",
    "cleaning_log_b",
    "rule_report_a",
    "profile_quality",
    "target_distribution",
    "star_view_2",
    "check_audit",
    "tpch_fk_audit",
    "tpch_unique_audit",
    "leakage_lineitem",
    "stratified_split",
    "threshold_sweep",
    "pr_summary",
    "combined_score",
]


def run(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from riskloom.plans.catalog import QUERIES
    from riskloom.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="riskloom-bench")
    warm_dir = str(Path(sf_dir).parent / "sf0.001")
    if Path(warm_dir).exists():
        for name in names:
            run(spark, QUERIES[name], warm_dir)

    timings = {}
    for name in names:
        timings[name] = round(run(spark, QUERIES[name], sf_dir), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_sec",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
