"""Headline timings; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veritable.operators import completeness, fingerprint, numeric, profile, uniqueness  # noqa: E402
from veritable.plans.scan import ScanConfig, scan  # noqa: E402
from veritable.session import build_session  # noqa: E402
from workload.more_queries import full_scan  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def run_scan(df, config=None):
    result = scan(df, config)
    result.issues.collect()
    result.release()


def main() -> None:
    spark = build_session("bench", CPUS, **{"spark.sql.shuffle.partitions": CPUS})
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    sampled = ScanConfig(
        sampling="reservoir",
        sample_size=200_000,
        keys=["l_orderkey", "l_linenumber", "l_partkey"],
    )

    outliers = ScanConfig(detectors=tuple(numeric.DETECTORS), fingerprint=False)

    def orders_scan():
        result = full_scan(spark, SF_DIR)
        result.issues.collect()
        result.release()

    queries = {
        "profile": lambda: profile.profile(lineitem).collect(),
        "profile_approx": lambda: profile.profile(lineitem, approx=True).collect(),
        "numeric_outliers": lambda: run_scan(lineitem, outliers),
        "null_rate": lambda: completeness.excessive_null_rate(lineitem).collect(),
        "uniqueness": lambda: uniqueness.uniqueness_violation(lineitem).collect(),
        "statistics_fingerprint": lambda: fingerprint.statistics_fingerprint(lineitem),
        "content_fingerprint": lambda: fingerprint.content_fingerprint(lineitem),
        "full_scan": lambda: run_scan(lineitem),
        "full_scan_orders": orders_scan,
        "sampled_scan": lambda: run_scan(lineitem, sampled),
    }
    seconds = {}
    for name, fn in queries.items():
        best = None
        for _ in range(1 + REPEATS):
            start = time.perf_counter()
            fn()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr)
    rows = lineitem.count()
    print(
        json.dumps(
            {
                "metric": "total_seconds_best_of_runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "lineitem_rows": rows,
                "full_scan_rows_per_sec": round(rows / seconds["full_scan"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
