"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query runs once to warm up, then BENCH_RUNS times (default
3); the median counts. Results are written to Spark's noop sink, so all rows
and columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyframe.session import local_session
from tallyframe.workload.queries import ALL_QUERIES

HEADLINE = (
    "trend_revenue",
    "trend_orders",
    "trend_aov",
    "trend_revenue_sales",
    "trend_orders_sales",
    "trend_by_segment",
    "latest_change",
    "compare_custom",
    "drivers_priority_revenue",
    "drivers_region_aov",
    "drivers_brand_revenue",
    "drivers_all",
    "anomalies_by_segment",
    "forecast_by_segment",
    "profile_dataset",
    "profile_columns",
    "sql_monthly_revenue",
    "sql_orders_by_segment",
    "kpi_by_segment_aov",
    "kpi_summary_by_region",
    "investigation_steps",
    "report_bundle",
    "report_sales",
    "tag_conversations",
    "tag_documents",
)


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=cores)
    timings = {}
    for name in names:

        def run(query=ALL_QUERIES[name]):
            return query(spark, sf_dir)

        seconds(run)
        timings[name] = round(statistics.median(seconds(run) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
