"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table directory, BENCH_CPUS the number of local cores.
Every query is written to the no-op sink, so that all its rows and columns are
computed; the time of a query is the better of two runs after a warm-up query.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from ledgerpulse.plans.catalog import QUERIES
from ledgerpulse.session import build_session

DIRECTORY = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2
HEADLINE = (
    "mrr_by_month", "mrr_by_month_and_segment", "churn_by_month", "churn_by_quarter", "arpu_by_month", "dashboard_kpis",
    "cohort_grid", "clv_cohort", "growth_mom_qoq", "clean_customers", "clean_subscriptions", "clean_transactions",
    "quality_report", "quality_gate", "dataset_summary", "transactions_per_customer", "merged_table", "customer_features",
    "latest_record", "train_test_split", "recency_roc_auc", "recency_threshold_metrics", "risk_ranking", "top_at_risk",
    "risk_digest", "forecast_summary", "forecast_by_segment", "forecast_accuracy", "kpi_cards", "csv_load_and_merge",
    "churn_logistic_scores",
)


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, DIRECTORY).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "ledgerpulse-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerpulse-bench-"))  # one machine
    run(spark, "mrr_by_month")
    seconds = {name: round(min(run(spark, name) for _ in range(RUNS)), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(DIRECTORY.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
