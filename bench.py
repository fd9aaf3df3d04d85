"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "status_reconcile", "review_flags", "dedup_findings", "run_counts", "check_groups", "ordered_groups", "group_accounts",
    "chunk_assign", "merged_groups", "approval_apply", "board_edits", "enrich_results", "report_rows", "audit_events",
    "ingest_summary", "run_manifest", "nested_flatten", "csv_scan", "html_strip", "control_dedup", "control_refs", "control_report",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sightline-bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sightline.plans.catalog import QUERIES

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM and the readers
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
