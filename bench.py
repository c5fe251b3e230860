"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is fully executed (its rows are written to a no-op sink) after one warm-up query.
"""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from stallkeeper.plans import registry  # noqa: E402

HEADLINE = [
    "dq_null_profile", "dq_iqr_summary", "clean_orders", "clean_delivery", "clean_payments", "representative_review",
    "m03_aov", "m09_retention", "m12_repurchase_interval", "m18_category_share", "metric_monthly_trends", "monthly_kpi",
    "daily_kpi", "growth_mom_yoy", "holiday_windows", "payment_structure", "state_change", "structural_signals",
    "customer_profile", "market_potential", "cohort_monthly", "short_term_repeat", "lifecycle_comparison", "rfm_detail",
    "churn_comparison", "churn_association", "payment_behavior_groups", "category_pareto", "category_class",
    "category_satisfaction", "negative_keywords", "association_product", "association_category", "scenario_delivery",
    "regime_segmentation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = sys.argv[1:] or HEADLINE
    queries["monthly_kpi"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
