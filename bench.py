"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One query warms the JVM, then each is timed once. Results go to the no-op sink, so every
row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sensorloom.plans.catalog import QUERIES
from sensorloom.session import local_session

HEADLINE = (
    "a11_equal_recording_mean",
    "a8_a10_recording_results",
    "a1_timestamp_audit",
    "a4_channel_description",
    "a29_gravity_dominance",
    "a30_domain_shift",
    "a31_extreme_values",
    "w2_window_counts",
    "w3_windows",
    "w7_causal_filter",
    "w12_autocorrelation",
    "k1_leave_one_recording_out",
    "k7_nested_selection",
    "k8_all_results",
    "a19_a20_context_summary",
    "a28_paired_comparison",
    "c2_audit_verdict",
    "s1_asl_scan",
    "x1_live_filter",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])
    for name in HEADLINE:
        started = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
