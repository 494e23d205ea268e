"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gridlens.plans import catalog
from gridlens.session import local_session

HEADLINE = [
    "rolling_alarm_rows",
    "alarm_counts_by_entity",
    "onset_residual",
    "sustained_windows",
    "numeric_stats",
    "stats_rollup",
    "reason_counts_capped",
    "time_histogram",
    "series_tiled_bins",
    "step_anchor",
    "nearest_sample_join",
    "common_mode",
    "drift_by_entity",
    "piecewise_knee",
    "outlier_vote",
    "stratified_sample",
    "evidence_ledger",
    "html_text",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    table, took = catalog.queries(), {}
    table["stats_rollup"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM
    for name in HEADLINE:
        began = time.perf_counter()
        table[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
