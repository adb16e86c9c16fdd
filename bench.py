"""Time the registered queries: warm run, then the median of the measured runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from landsieve.registry import QUERIES  # noqa: E402
from landsieve.session import build_session  # noqa: E402

HEADLINE = [
    "q_min_size", "q_exclusions", "q_airport_anti", "q_transmission", "q_min_kv", "q_roadway", "q_provider", "q_funnel",
    "q_iso_join", "q_drive_time", "q_nearest_line", "q_nearest_road", "q_nearest_substation", "q_polygon_anti",
    "q_lookup_zoning", "q_lookup_fema", "q_lookup_large", "q_norm", "q_norm_by_county", "q_mcda", "q_mco", "q_stats_mcda",
    "q_median", "q_top5", "q_explain", "q_providers", "q_retention", "q_county_counts", "q_schema_states", "q_site_selection",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "landsieve-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 4)
        print(f"{name:24s} {seconds[name]:8.3f}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
