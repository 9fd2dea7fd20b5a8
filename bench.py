"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from floodspark.plans.queries import QUERIES  # noqa: E402
from floodspark.session import get_session  # noqa: E402

HEADLINE = (
    "flow_diagnostics", "run_summary", "peak_envelope", "mesh_qa", "mesh_inradius_stats", "points_in_zones",
    "assign_friction", "align_forcing", "interpolate_boundary", "node_lines", "clip_lines", "breakline_grading",
    "grid_knn", "nearest_vertex", "raster_nodata_in_boundary", "compare_runs", "footprint_clusters",
    "package_report", "phase_durations", "heartbeats", "flow_diagnostics_live",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flow_diagnostics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
