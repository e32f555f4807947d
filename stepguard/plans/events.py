"""A second rule set, for tables of user events.

Group is the user, order is (time, event id), state is the event type, and the
channels are ``value`` and the number ``k`` inside ``props``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepguard.functions.hashing import seeded_key
from stepguard.functions.numbers import tolerant_number
from stepguard.operators.adjacent import add_steps
from stepguard.operators.rules import Rule, add_labels, state_bucket
from stepguard.operators.splits import split_by_share

GROUP = "user_id"
ORDER = ["ts_us", "event_id"]
CHANNELS = ["value", "k"]
STATES = ["purchase", "error"]
BUCKETS = ["a", "b", "other"]
SPLIT_SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}

RULES = [
    Rule("r1", "value", "jump", 100.0, ("purchase",), {"tight": 1.0, "primary": 5.0, "broad": 20.0}),
    Rule("r2", "k", "jump", 80.0, ("purchase",), {"tight": 1.0, "primary": 3.0, "broad": 8.0}),
    Rule("r3", "value", "jump", 250.0, None, {"tight": 1.0, "primary": 5.0, "broad": 20.0}),
    Rule("r4", "k", "jump", 95.0, None, {"tight": 1.0, "primary": 2.0, "broad": 4.0}),
    Rule("r5", "value", "level", 200.0, ("error",), {"tight": 1.0, "primary": 5.0, "broad": 20.0}),
]
RULE_NAMES = [rule.name for rule in RULES]

REMOVALS = {
    "original_all_rules": [],
    "remove_r1": ["r1"],
    "remove_r3": ["r3"],
    "remove_r5": ["r5"],
    "remove_r1_r5": ["r1", "r5"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_micros(name: str, kind: str) -> Column:
    """Microseconds since 1970 of a time with or without zone.

    A time without zone is counted as it is written, whatever the session's zone.
    """
    if kind != "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    passed = f"({name} - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    hours = f"extract(DAY FROM {passed}) * 24L + extract(HOUR FROM {passed})"
    minutes = f"({hours}) * 60L + extract(MINUTE FROM {passed})"
    micros = f"cast(extract(SECOND FROM {passed}) * 1000000 AS bigint)"
    return F.expr(f"({minutes}) * 60000000L + {micros}")


def from_raw(raw: DataFrame) -> DataFrame:
    """Typed events, from a batch table or a stream."""
    return raw.select(
        "event_id",
        epoch_micros("ts", dict(raw.dtypes)["ts"]).alias("ts_us"),
        "user_id",
        F.col("event_type").alias("state"),
        "value",
        tolerant_number(F.get_json_object("props", "$.k")).alias("k"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return from_raw(table(spark, folder, "events"))


def labelled(df: DataFrame, **options) -> DataFrame:
    stepped = add_steps(df, [GROUP], ORDER, CHANNELS, **options)
    return add_labels(stepped, RULES)


def with_buckets(df: DataFrame) -> DataFrame:
    """Adds the state bucket and the split of the user."""
    return df.withColumns(
        {
            "bucket": state_bucket(F.col("state"), {"purchase": "a", "error": "b"}, "other"),
            "split": split_by_share(seeded_key("split", F.col(GROUP)), SPLIT_SHARES),
        }
    )


def labelled_events(spark: SparkSession, folder: str) -> DataFrame:
    return with_buckets(labelled(events(spark, folder)))
