"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); query names as arguments
restrict the run, ``all`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = ("subject_rates interval_union interval_subtract interval_overlap_per_row points_inside overlap_pairs claim_join "
            "threshold_sweep channel_groups reconciled_events bounded_merge circadian_hourly elapsed_days around_events "
            "peri_exclusion_rates detector_performance scope_group_rates percentiles correlations group_comparison "
            "moving_mean line_length outlier_interpolation event_metrics run_diff priority_lookup").split()


def main() -> None:
    from tidemark.catalog import ENTRIES
    from tidemark.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    names = list(ENTRIES) if names == ["all"] else names
    ENTRIES["interval_union"].run(spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM paths
    times = {}
    for name in names:
        t0 = time.time()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
