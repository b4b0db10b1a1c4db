"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each query is built and run to completion into a sink that discards the rows.
The figure per query is the median of BENCH_RUNS runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = (
    "q02_spec_project_alias_filter",
    "q08_columns_shared",
    "q12_duplicate_keys",
    "q13_key_ordinal",
    "q14_row_status",
    "q15_source_only",
    "q17_matched_wide",
    "q18_duplicate_pairing",
    "q18_duplicate_stats",
    "q21_mixed_types",
    "q23_null_keys",
    "q24_long_texts",
    "q25_column_stats",
    "q26_row_summary",
    "q29_matched_sample",
    "q30_mismatch_samples",
    "q32_summary_document",
    "q33_job_latest_state",
    "q36_hot_key_status",
    "q37_hot_copies_status",
)


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> tuple[float, float]:
    """Seconds to build the query, which may run small jobs, and to execute it."""
    began = time.perf_counter()
    result = QUERIES[name](spark, sf_dir)
    built = time.perf_counter()
    result.write.format("noop").mode("overwrite").save()
    return built - began, time.perf_counter() - built


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds, detail = {}, {}
    for name in names or HEADLINE:
        run(spark, name, sf_dir)
        timed = [run(spark, name, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(sum(t) for t in timed), 3)
        detail[name] = round(statistics.median(t[0] for t in timed), 3)
    print(
        json.dumps(
            {
                "metric": "median seconds per query, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "build": detail,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
