"""Time the headline queries; prints one line of JSON.

Each query runs once to warm up and then ``BENCH_RUNS`` times (default 3) over all its
rows; its time is the median. ``BENCH_SF_DIR`` is the folder of the tables and
``BENCH_CPUS`` the number of cores. Arguments name other queries; ``all`` takes every one.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voltfleet.session import build_session  # noqa: E402
from workload.jobs import JOBS  # noqa: E402

HEADLINE = (
    "read_state",
    "chart_series",
    "time_keys",
    "rollup_hour_of_day",
    "rollup_date_hour",
    "rollup_day_in_week",
    "rollup_day_7d",
    "rollup_month_selected",
    "rollup_month_6m",
    "rollup_device_hours",
    "minmax_hourly",
    "summary_month",
    "summary_device",
    "stats_24h",
    "stats_24h_device",
    "failure_runs",
    "available_weeks",
    "available_months",
    "latest_reading",
    "latest_reading_device",
    "ordered_series",
    "active_config",
    "fold_config",
    "hourly_table",
    "dashboard",
    "dashboard_series",
    "delete_day",
    "stream_stats_24h",
    "stream_outage",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    names = JOBS if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            JOBS[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of the median times of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
