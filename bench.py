"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from itemloom.plans import catalog, standins
from itemloom.plans.consolidation import run_all

HEADLINE = [
    "direction_case", "latest_filing", "fiscal_items", "inventory_report", "border_tax", "canonical",
    "normalize_text", "classify_tiers", "product_index", "audited_items", "representative_codes",
    "unified_descriptions", "split_codes", "final_products", "code_mapping", "annual_sums_long",
    "annual_sums_pivot", "filter_text", "filter_numeric", "page", "report_rows", "merge_groups", "registry",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = os.environ.get("BENCH_WORK") or tempfile.mkdtemp(prefix="itemloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", work)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the session, the readers and the compiler is not a query.
    catalog.representative_codes(spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    run_all(
        spark, standins.sources(spark, sf_dir), standins.references(spark, sf_dir),
        f"{work}/result",
    )
    seconds["run_all"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
