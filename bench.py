"""Benchmark the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed completely through the ``noop`` sink (every row is
produced, nothing is collected to the driver). One warm-up query absorbs JVM
start-up; it is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairshift.plans.queries import QUERIES  # noqa: E402
from pairshift.session import build_session  # noqa: E402

HEADLINE = [
    "build_nli_examples",
    "build_qa_examples",
    "perturb",
    "tokenizer_stats",
    "token_histogram",
    "js_divergence",
    "pair_rows",
    "f1_per_example",
    "robustness_report",
    "cross_language",
    "length_stats",
    "representation_shift",
    "pool_mean",
    "efficiency_summary",
    "scaling_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", app_name="pairshift-bench", shuffle_partitions=max(8, 2 * cpus))
    QUERIES["normalize_ws"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
