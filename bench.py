"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from restwave.session import build_session  # noqa: E402
from workload.queries import registry  # noqa: E402

HEADLINE = (
    "daily_mean_calendar", "sma_all_widths", "gaussian_rows_all_widths", "kernel_gaussian", "kernel_boxcar",
    "kernel_all_bandwidths", "kernel_many_series", "smooth_wide", "zero_to_null_units", "workout_agg",
    "workout_agg_by", "ingest_health_stats", "ingest_sleep", "ingest_heart_rate_detailed",
    "ingest_steps_detailed", "load_rows", "missing_dates", "upsert_daily", "upsert_intraday", "activity_list",
    "strength_sets", "dq_unique", "series_sleep", "io_roundtrip_parquet",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for name in ("daily_mean_calendar", "kernel_gaussian"):
        run(name)  # starts the scheduler, the file readers and the Python workers; not counted
    times = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
