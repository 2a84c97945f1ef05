"""Runs the headline queries warm at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "pair_correlation", "rolling_pair_corr", "basic_stats_events", "basic_stats_orders", "normalise_zscore", "normalise_minmax", "normalise_rank", "cross_correlation", "volatility", "trend", "autocorrelation", "hurst_rs", "mutual_information",
    "transfer_entropy", "rank_dependence", "window_rowcount", "window_calendar", "excursion_summary", "cohorts", "eigen_structure", "cluster_ensemble", "pair_kernels",
]
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from geoloom.catalog import QUERIES

    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    took = {}
    for name in chosen:
        times = []
        for k in range(RUNS + 1):  # the first run is warm-up
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times), 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, warm median, total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
