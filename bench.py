"""Times the headline queries once each, warm session, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from benchset.registry import QUERIES  # noqa: E402

HEADLINE = [
    "air_score", "water_sites", "school_grades", "incident_units", "point_zone_first", "incident_zone_index",
    "zone_quality", "zone_overlay", "rollup_zone", "rollup_borough", "combined_index", "stream_incident_units",
    "index_table", "leaderboards", "metric_stats",
]
# Rows of the tables that a headline query reads most of.
INPUTS = {"incident_units": "events", "incident_zone_index": "events", "point_zone_first": "events", "stream_incident_units": "events"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wardscore-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="wardscore-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that the start of the session is not counted.
    QUERIES["air_pivot"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    count = lambda name: spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).count()
    rows = count("lineitem")
    sizes = {name: count(name) for name in set(INPUTS.values())}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").split("sf")[-1],
                "lineitem_rows": rows,
                "rows_per_sec": {q: round(sizes[t] / seconds[q]) for q, t in INPUTS.items() if q in seconds},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
