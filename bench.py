"""Times the headline queries and prints one JSON line.

Every query is run to the last row into a sink that drops the rows. The first
run of the session warms the JVM up on the smallest query and is not counted.
``text_verifier_stored`` reads question texts that were rendered beforehand, so
it measures the same work as the published verifier rate: one pass over stored
texts, median of several repeats after warm-ups. All other queries start from
the Parquet tables and report the better of two runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from stepguard.plans import cycler as cy  # noqa: E402
from stepguard.plans.catalog import QUERIES  # noqa: E402
from stepguard.plans.catalog.texts import questions  # noqa: E402
from stepguard.session import scratch_path  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
VERIFIER_WARM_UPS, VERIFIER_REPEATS = 3, 7

HEADLINE = [
    "b07_rule_evaluation",
    "b23_text_verifier",
    "c01_previous_row",
    "c02_previous_row_whole_table",
    "c05_rolling_sequence",
    "c09_chronological_split",
    "d01_group_profile",
    "d04_trigger_counts",
    "d08_threshold_coverage",
    "d09_rule_removal_sensitivity",
    "d10_distribution_summary",
    "d11_pearson_matrix",
    "d12_confusion_metrics",
    "d14_d15_auroc_average_precision",
    "d16_tuned_threshold",
    "d18_e07_mcnemar_all_pairs",
    "d26_leakage_summary",
    "e03_alignment_audit",
    "f05_balanced_sample",
    "f07_stratified_row_split",
    "f08_stratified_group_split",
    "h01_streamed_rules",
    "i03_isolation_forest",
]


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    best = float("inf")
    for _ in range(REPEATS):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("stepguard-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["b05_state_bucket"](spark, FOLDER))

    texts = scratch_path(spark, "bench-texts")
    questions(spark, FOLDER).repartition(int(CPUS)).write.parquet(texts)
    stored = spark.read.parquet(texts)
    rows = stored.count()

    passes = []
    for _ in range(VERIFIER_WARM_UPS + VERIFIER_REPEATS):
        start = time.perf_counter()
        drain(cy.verified(stored, "text"))
        passes.append(time.perf_counter() - start)
    times = {"text_verifier_stored": round(statistics.median(passes[VERIFIER_WARM_UPS:]), 3)}
    for name in HEADLINE:
        times[name] = timed(lambda: drain(QUERIES[name](spark, FOLDER)))
    rate = rows / times["text_verifier_stored"]
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(FOLDER).name,
                "text_verifier_rows_per_sec": round(rate),
                "text_verifier_rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
