"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all"
BENCH_RUNS     timed runs per query, the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import re
import time
from statistics import median

from parkpulse.plans.catalog import catalog
from parkpulse.session import local_session

HEADLINE = (
    "parsed_messages", "status_v1", "status_v2", "error_summary_sensor", "error_summary_v2_site",
    "stays_v1", "stays_v2", "stay_summary", "usage_by_hour", "usage_by_grain_date",
    "dwell_by_site_hour", "top_sensors_dwell", "peak_dwell", "occupancy_hourly",
    "occupancy_by_hour", "occupancy_by_site_weekday", "occupancy_heatmap", "occupancy_site_date",
    "occupancy_grid_dense", "occupancy_profile_transposed", "occupancy_summary_stats",
    "anova_dwell_by_site", "tukey_dwell", "occupancy_wide", "top_sensors_occupancy", "stays_v1_cut",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = catalog()
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE

    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("usage_by_hour", "occupancy_by_hour"):  # start the JVM's compilers
        once(name)
    seconds = {name: round(median(once(name) for _ in range(runs)), 3) for name in names}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total median wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
