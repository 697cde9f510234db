"""Headline queries over the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is warmed up by a first untimed query (JVM start), then run once and
written to Spark's no-op sink, so every row is produced but none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitalgrid.plans.catalog import load  # noqa: E402
from vitalgrid.session import local_session  # noqa: E402

HEADLINE = (
    "nm1_zscore", "nm8_iqr_normalization", "wf1_rolling_median_subtract", "wf3_iqr_normalization_adaptive",
    "wf13_close_then_open", "wf15_runs", "ag12_signal_feature_set", "ag16_hrv_time_domain",
    "ag25_movement_epoch_features", "sp1_psd", "jn1_interval_iou", "jn5_mask_labels", "iv4_score_runs",
    "me13_auroc", "me30_event_f1", "ls5_focal_weighted", "ud6_run_study_spec",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    entries = load()
    run = lambda name: entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    run("ex1_divide")
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - begin, 3)
    out = {
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
