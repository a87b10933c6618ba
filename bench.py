"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated names).
Each query runs twice in one session, all rows and columns computed; the second run is reported.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "conditions_full",
    "j_prefix_codes",
    "cp_cancer_stays",
    "cp_cohort",
    "cp_external_knowledge",
    "lf_extract_spans",
    "lf_sentences",
    "lf_external",
    "j_temporal_window",
    "cp_apply_lfs",
    "lm_label_matrix",
    "lm_tasks",
    "lm_posterior",
    "lf_summary",
    "j_span_overlap",
    "cp_annotations",
    "metrics_prf",
    "sl_negatives",
    "cp_select",
    "w_rolling_mean",
    "cp_fhir",
    "metrics_table",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from queries.catalog import QUERIES

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clinspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm, rows = {}, {}, {}
    for name in names:
        for times in (cold, warm):
            began = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    if os.environ.get("BENCH_ROWS"):
        rows = {n: QUERIES[n](spark, directory).count() for n in names}
    result = {
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": Path(directory).name.removeprefix("sf"),
        "cpus": int(cpus),
    }
    if rows:
        result["rows"] = rows
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
