"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import catalog  # noqa: E402,F401
from catalog.registry import ENTRIES  # noqa: E402
from parapet.session import local_session  # noqa: E402

HEADLINES = (
    "f15_cleaning_funnel", "a1_occupancy_counts", "a3_annual_series", "a5_decade_classes", "a10_era_matrix",
    "a9_cell_breakdown", "a15_water_table", "a17_soil_components", "a18_soil_by_class", "a19_risk_summary",
    "a20_resolution_stats", "a25_hierarchy_views", "a26_flow_table", "a28_vote_links", "c9_vote_list",
    "s7_sample_chunks", "p2_stratified_sample", "d5_match_rate", "d7_demolitions", "d8_filled_land", "m10_batched_models",
    "a30_cluster_analysis", "m6_class_clusters",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores, app="bench", spark__ui__showConsoleProgress="false")
    # One small query first, so that the first headline does not pay for starting up.
    ENTRIES["a1_occupancy_counts"].run(spark, "/root/testdata/sf0.001").collect()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
