"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_ALL=1`` runs
every registered query. The load (clean, match, attach, publish) is timed first
as ``load``; the other times are of queries over the published tables. Each
query is run in full by a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import time

from tillframe.plans.queries import QUERIES
from tillframe.plans.warehouse import warehouse
from tillframe.session import local_session

HEADLINE = (
    "clean_sales", "top_products", "distinct_customers", "product_kpi", "customer_kpi", "product_alerts",
    "data_quality_summary", "revenue_by_period", "sales_by_country", "product_monthly_revenue", "rating_distribution",
    "latest_reviews", "dq_report", "hard_match", "fuzzy_match", "tfidf_match", "golden_records", "attach_reviews_tfidf",
    "semantic_assign", "column_summary", "customer_segments", "rfm_scores", "churn_labels", "churn_risk",
    "customer_clusters", "product_score", "holt_forecast", "holt_winters_forecast", "vector_search", "extract_sql",
)
PUBLISHED = ("sales", "products", "customers", "mapping", "reviews")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    times = {"load": timed(lambda: [getattr(warehouse(spark, folder), t).count() for t in PUBLISHED])}
    for name in QUERIES if os.environ.get("BENCH_ALL") else HEADLINE:
        times[name] = timed(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cores": cores,
        "load_lines_per_second": round(warehouse(spark, folder).table("lineitem").count() / times["load"]),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
