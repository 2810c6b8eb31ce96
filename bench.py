"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from scrapelake.plans.checks import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "instant_latest",
    "instant_max_age",
    "range_open_closed",
    "match_regex",
    "limit_counts",
    "result_flat",
    "result_nested",
    "histogram_view",
    "histogram_range",
    "summary_view",
    "view_flat",
    "upsert_last_wins",
    "series_first_wins",
    "parse_round_trip",
    "parse_errors",
    "metadata_last_wins",
    "merge_exported",
    "label_rows",
    "synthetic_samples",
    "orphan_series",
    "lake_instant",
    "lake_range",
    "lake_histogram",
]


def timed(spark: SparkSession, name: str) -> float:
    """Seconds from building the query to its last row."""
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The better of two runs, so that loading classes does not count.
    seconds = {name: round(min(timed(spark, name) for _ in range(2)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
