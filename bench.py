"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from salesmart.session import build_session
from workload import QUERIES

HEADLINES = [
    "revenue_month_growth", "sales_with_details", "customer_facts", "customer_retention", "product_daily",
    "sales_trend", "clean_main", "clean_lines", "rfm_segments", "customer_value_segment", "customer_features",
    "product_features", "rolling_features", "customer_summary", "trend_summary_growth", "product_potential_top",
    "top_customers", "repeat_rate", "prompt_routes", "prompt_revenue", "favorite_category", "seasonality_index",
    "rfm_from_facts", "product_revenue_segment", "lag_features_ungrouped", "churn_metrics",
]


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute every row; nothing is sent to the driver or to disk."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the engine
    # the first run also pays for compiling the plan; both are reported, the value is their mean
    runs = {name: [round(run(spark, name, sf_dir), 3) for _ in range(2)] for name in names}
    times = {name: round(sum(both) / 2, 3) for name, both in runs.items()}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "runs": runs, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
