"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from attestor.plans import catalog

HEADLINE = [
    "r9_resolve", "r11_resolve_all", "r8_rescind", "r1_choose_case", "r4_rank_clusters", "r3_name_clusters", "x10_risk_union", "x13_consensus",
    "l1_line_group", "l2_reading_order", "l9_same_row_join", "f2_quarantine", "x2_label_value_pairs", "x3_running_applicant",
    "a1_a7_policy", "a10_assemble", "h1_h2_recovery", "c1_c3_trace_features", "c4_empirical_bayes", "c7_ridge", "c9_isotonic_fit",
    "e5_e8_case_scores", "e9_summary", "d1_stratified_split", "d4_error_groups", "n1_n24_scalar_functions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
