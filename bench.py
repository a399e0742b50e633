"""Time the headline queries and print one JSON line. Results go nowhere: every row is computed."""

import json
import os
import time

from pyspark.sql import SparkSession

from loomgraph import queries

HEADLINE = ["surface_bypass", "edge_rules", "edge_coverage", "edge_counts", "fan", "cycle_components", "ledger_suppress", "hotspots", "co_changes", "covering_prefix", "layered_order", "type_leaks", "file_membership", "search_scores"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
