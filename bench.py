"""Times the headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rulespark.plans.queries import QUERIES

HEADLINE = [
    "duplicate_rows",
    "reference_exists",
    "records_unique",
    "ordered_records",
    "roles_disjoint",
    "roles_same_duty",
    "set_subset",
    "coverage",
    "applicability_alignment",
    "statistics_rollup",
    "finding_identity",
    "run_diff",
    "vocabulary",
    "deleted_text_reappears",
    "candidate_rank",
    "engine_findings",
    "check_value_mapping_5",
    "term_provenance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "0")) or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["unit_rollup"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the executors
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
