"""Time the headline queries and print one JSON line. Reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tremolite import registry
from tremolite.session import local_session

HEADLINE = [
    "vp_vs_experiment", "spread_to_nodes", "node_regression_pvalue", "arrivals_in_bbox", "events_in_cylinder",
    "travel_times_by_region", "travel_times_bbox", "region_join", "radius_join_nodes", "node_intersect", "phase_pivot",
    "origin_deviation", "travel_deviation", "event_origin_spread", "split_welch", "hypo_rms", "hypo_summary",
    "trimmed_histogram", "refine_trilinear", "interpolate_points", "field_gradient", "cell_lookup_join", "fat_ray",
    "pairwise_misfit", "softmin_weights", "top_n_weights", "ray_cell_lengths", "station_sums", "normal_equations",
    "ray_time", "travel_field", "write_event_tables", "scan_event_tables",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    registry.load()
    spark = local_session(cores, "bench", os.environ.get("BENCH_MEMORY", "16g"))
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start the session before the clock
    seconds, failed = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        try:
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(name, seconds.get(name, "failed"), file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)$", folder)
    out = {
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(sf.group(1)) if sf else folder,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
