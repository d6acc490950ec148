"""Times registered queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_RUNS the timed runs
per query (median, after one warm-up) and BENCH_QUERIES a comma-separated
selection, or "all". Results go to Spark's noop sink: every row is computed,
none is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyloom.registry.queries import QUERIES  # noqa: E402
from tallyloom.session import intermediates, local_session  # noqa: E402

HEADLINE = [
    "top_products",
    "category_revenue_share",
    "customer_aov",
    "monthly_sales_trend",
    "least_category_per_state",
    "customer_clv_rank",
    "slow_shipping",
    "payment_status_share",
    "top_seller_success",
    "product_margin_rank",
    "top_returned_products",
    "inactive_sellers",
    "customer_return_class",
    "top_customers_per_state",
    "provider_performance",
    "yoy_decline",
    "kpi_summary",
    "cohort_retention",
    "cohort_pivot",
    "fulfillment_funnel",
    "event_funnel",
    "ab_test_readout",
    "status_matrix",
    "apply_sales_outcomes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    selection = os.environ.get("BENCH_QUERIES", "")
    chosen = list(QUERIES) if selection == "all" else [q for q in selection.split(",") if q] or HEADLINE

    spark = local_session(cpus, shuffle_partitions=8)
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            with intermediates(spark):
                start = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
                "shuffle_partitions": 8,
            }
        )
    )


if __name__ == "__main__":
    main()
