"""Benchmark: warehouse build + headline queries at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.

``build`` is the whole pipeline (lake write + manifest hashing + verify +
star build with stable keys + gate + publish). Every other query runs on the
published warehouse / source tables and is forced to completion with the
``noop`` sink, so its time covers the full plan without driver transfer.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "revenue_summary", "revenue_summary_window", "sales_by_category", "top_products",
    "sales_by_city", "daily_sales", "sales_weekly", "sparkline", "kpi_delta",
    "orders_page", "order_totals", "customer_search", "quality_report", "validation_report",
    "dataset_statistics", "loyal_share", "order_intake", "order_intake_merged",
    "redact_errors", "run_audit_state", "pipeline_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tallyhouse.session import get_session
    from tallyhouse.plans import registry

    spark = get_session(f"local[{cpus}]", app_name="tallyhouse-bench",
                        shuffle_partitions=max(cpus * 2, 8),
                        extra={"spark.driver.memory": "16g"})
    qs = registry.queries()
    times: dict[str, float] = {}

    t = time.time()
    registry.warehouse(spark, sf_dir, reuse=False)  # always a full, fresh build
    times["build"] = round(time.time() - t, 3)

    for name in HEADLINE:
        t = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
