"""Streaming rules, run over the event file and checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepguard.functions.numbers import one_hot
from stepguard.plans import events as ev
from stepguard.plans.catalog.profiles import STEP_FEATURES
from stepguard.plans.catalog.registry import LAB, query
from stepguard.session import scratch_path
from stepguard.streaming.labels import (
    label_stream,
    run_counts,
    run_to_table,
    running_counts,
    sequence_stream,
    table_stream,
)


def event_stream(spark, folder):
    return ev.from_raw(table_stream(spark, folder, "events"))


def drained(stream, name):
    spark = stream.sparkSession
    return run_to_table(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-state"))


@query(
    "h01_streamed_rules",
    LAB + """SELECT event_id, previous_value, r1, r2, r3, r4, r5, is_anomaly, false AS late FROM lab""",
)
def h01(spark, folder):
    labelled = label_stream(
        event_stream(spark, folder), ev.GROUP, ev.ORDER, ev.CHANNELS, ev.RULES
    )
    table = drained(labelled, "labelled-stream")
    return table.select("event_id", "previous_value", *ev.RULE_NAMES, "is_anomaly", "late")


@query(
    "h02_streamed_sequences",
    LAB + """, s AS (SELECT event_id, list(value) OVER (PARTITION BY user_id
        ORDER BY ts_us, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS seq FROM ev)
      SELECT event_id, round(list_sum(list_transform(range(1, 9), lambda i: i * CASE WHEN i <= 8 - len(seq)
          THEN seq[1] ELSE seq[i - 8 + len(seq)] END)), 4) AS weighted FROM s""",
)
def h02(spark, folder):
    flags = one_hot(F.col("state"), ev.STATES, "state")
    stream = event_stream(spark, folder).select(
        "event_id", "ts_us", "user_id", "value", F.coalesce("k", F.lit(0.0)).alias("k"),
        *[c.alias(n) for n, c in flags.items()],
    )
    table = drained(
        sequence_stream(stream, ev.GROUP, ev.ORDER, STEP_FEATURES), "sequence-stream"
    )
    value = STEP_FEATURES.index("value")
    weighted = F.aggregate(
        F.transform("sequence", lambda s, i: F.get(s, F.lit(value)) * (i + 1)),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    return table.select("event_id", F.round(weighted, 4).alias("weighted"))


@query(
    "h03_running_counters",
    LAB + """SELECT state, count(*) AS total, count(*) FILTER (WHERE r1) AS r1,
      count(*) FILTER (WHERE r2) AS r2, count(*) FILTER (WHERE r3) AS r3,
      count(*) FILTER (WHERE r4) AS r4, count(*) FILTER (WHERE r5) AS r5 FROM lab GROUP BY state""",
)
def h03(spark, folder):
    """The stream labels into a table; a second stream counts that table in update mode."""
    labelled = label_stream(
        event_stream(spark, folder), ev.GROUP, ev.ORDER, ev.CHANNELS, ev.RULES
    )
    path = scratch_path(spark, "counted-source")
    run_to_table(labelled, path, scratch_path(spark, "counted-state"))
    source = spark.readStream.schema(labelled.schema).parquet(path)
    counts = running_counts(source, ["state"], ev.RULE_NAMES)
    return run_counts(counts, ["state"], scratch_path(spark, "counts"), scratch_path(spark, "counts-state"))
