"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]. Every query runs
twice; the second, warm time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from provenir.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "text_scan",
    "fuse_cores",
    "attention_fuse",
    "clip_verdict",
    "temporal_consistency",
    "periodicity",
    "closure_rhythm",
    "pairwise_sync",
    "heart_rates",
    "artifact_result",
    "spectrogram_result",
    "patch_stats",
    "cross_dataset",
    "auc_roc",
    "temperature_fit",
    "history_stats",
    "ledger_append",
    "ledger_verify",
    "histogram",
    "weights_as_of",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
