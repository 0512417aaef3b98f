"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables, default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (runs per query, the fastest counts, default 2),
BENCH_QUERIES (comma-separated names, or "all"). The result is consumed by
Spark's no-op sink, so every row is computed and none is sent to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillwork.plans.registry import registered
from tillwork.session import build_session
from tillwork.sources.scratch import release

HEADLINE = (
    "monthly_revenue", "top_products", "channel_performance", "customer_ltv_segments",
    "rfm_segments", "category_growth", "inventory_turnover", "day_of_week_sales", "hourly_sales",
    "regional_performance", "regional_category_rank", "discount_tiers", "price_tiers",
    "duplicate_count", "describe_numeric", "business_metrics", "order_value_histogram",
    "customer_behaviour", "filter_sales", "kpi_summary", "categorical_counts",
    "date_spine", "stationarity_test", "rolling_features", "autocorrelation",
    "seasonal_decompose", "arima_forecast", "additive_forecast", "forecast_metrics",
    "cross_sell_pairs", "customer_concentration", "retention_cohorts", "reorder_points",
    "kpi_drilldown", "stream_kpis", "validated_ingest",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    asked = os.environ.get("BENCH_QUERIES", "")
    available = registered()
    names = list(available) if asked == "all" else asked.split(",") if asked else list(HEADLINE)

    spark = build_session(
        "bench", f"local[{cpus}]", shuffle_partitions=cpus,
        **{"spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    # Start the executors' code paths before the clock runs.
    for name in ("monthly_revenue", "describe_numeric"):
        available[name](spark, root).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            available[name](spark, root).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    release(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
