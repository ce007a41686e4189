"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3). Other queries: pass names.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from forewarn.plans import load
from forewarn.session import build_session

#: Each query runs so often; the median counts.
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "x00_best_warning", "x06_trigger_table", "x10_threshold_search", "x11_yearly_hits", "x14_drought_quantile",
    "x25_impact_catalogue", "x27_forecast_metrics", "x28_classification_metrics", "x30_roc_points",
    "x39_leave_one_out_cue", "x19_spi", "x20_return_levels", "x12_return_period_triggers", "w03_trailing_days",
    "w05_locf", "a07b_quantiles_of_rows", "a17_zonal_stats", "a22_neighbour_overlap", "j10_point_in_polygon",
    "j14_nearest_stations", "j17_date_band", "j21_upstream_closure", "s09_partitioned_sink",
    "t01_incremental_ingest", "x46_indicator_refresh", "x39b_frugal_trees", "j13b_overlay_area",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/lineitem.parquet").count()  # start the JVM outside the timings
    registry[names[0]].run(spark, sf).write.format("noop").mode("overwrite").save()  # and compile what all queries share
    times = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.time()
            registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
