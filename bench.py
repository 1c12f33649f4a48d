"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then $BENCH_RUNS times (default 3); the median is
reported.  Results are materialised into Spark's ``noop`` sink, so the whole plan runs
without collecting to the driver.  Prints one JSON line.  ``BENCH_ALL=1`` times every
registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    # reports
    "sales_daily_range", "dashboard_stats", "sales_totals_filtered", "sales_page",
    "subscription_stats", "subscription_page", "promo_code_usage", "lesson_engagement",
    "partner_purchases", "partner_stats", "partner_revenue_all", "lesson_catalog",
    "progress_summary", "user_entitlements",
    # data jobs
    "promo_resolution", "application_admission", "payout_admission", "payout_status_payouts",
    "progress_upsert_existing", "user_purge_counts", "session_retention", "otp_code_check",
    "append_topics", "integrity_report",
    # streaming batch twin
    "rate_limit_daily",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from acadia.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="acadia-bench-ckpt-"))
    from acadia.plans import QUERIES
    names = sorted(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    timings: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
