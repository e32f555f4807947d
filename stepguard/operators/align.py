"""Checks that two tables talk about the same records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.operators.ordered import SEGMENT_ROWS, running_totals
from stepguard.session import checkpointed


def alignment_audit(
    reference: DataFrame,
    predictions: DataFrame,
    record_id: str,
    gold: str,
    pred: str,
    score: str,
    threshold: float,
) -> DataFrame:
    """Ids on one side only, duplicates, label and verdict mismatches, odd scores."""
    left = reference.groupBy(record_id).agg(
        F.count(F.lit(1)).alias("__left"), F.bool_or(gold).alias("__left_gold")
    )
    value = F.col(score)
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    right = predictions.groupBy(record_id).agg(
        F.count(F.lit(1)).alias("__right"),
        F.bool_or(gold).alias("__right_gold"),
        F.count_if(odd).alias("__odd"),
        F.count_if(F.col(pred) != (value >= threshold)).alias("__differs"),
    )
    both = left.join(right, record_id, "full")
    return both.agg(
        F.count_if(F.col("__right").isNull()).alias("reference_only"),
        F.count_if(F.col("__left").isNull()).alias("prediction_only"),
        F.count_if(F.col("__left") > 1).alias("duplicate_reference_ids"),
        F.count_if(F.col("__right") > 1).alias("duplicate_prediction_ids"),
        F.count_if(F.col("__left_gold") != F.col("__right_gold")).alias("gold_mismatches"),
        F.coalesce(F.sum("__differs"), F.lit(0)).alias("verdict_mismatches"),
        F.coalesce(F.sum("__odd"), F.lit(0)).alias("nonfinite_scores"),
    )


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within an absolute or relative tolerance; null equals only null."""
    allowed = F.greatest(F.lit(1.0), F.abs(a), F.abs(b)) * tolerance
    # max(tolerance, tolerance * |largest|) is tolerance * max(1, |largest|).
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(
        F.abs(a - b) <= allowed
    )


def metric_check(
    stored: DataFrame, computed: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12
) -> DataFrame:
    """Stored against recomputed values, one row per key with an ``ok`` flag."""
    a = stored.select(*keys, F.col(value).alias("stored"), F.lit(True).alias("__in_stored"))
    b = computed.select(*keys, F.col(value).alias("computed"), F.lit(True).alias("__in_computed"))
    both = a.join(b, list(keys), "full")
    present = F.col("__in_stored").isNotNull() & F.col("__in_computed").isNotNull()
    return both.withColumn(
        "ok", present & close(F.col("stored"), F.col("computed"), tolerance)
    ).drop("__in_stored", "__in_computed")


def positions(
    df: DataFrame, source: Sequence[str], order: Sequence[str], segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """One-based position of each record inside its source."""
    return running_totals(df, source, order, {"position": F.lit(1)}, segment_rows=segment_rows)


def sequence_digest(numbered: DataFrame) -> tuple[int, int, int]:
    """Rows, and two order-sensitive sums over (position, key) that merge over any ranges.

    Each row adds a hash of its position and key, so a key at another place gives other
    sums. Two sums of different hashes make 128 bits.
    """
    wide = [F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)) for h in (
        F.xxhash64("position", "__key"), F.xxhash64(F.lit(1), "__key", "position"))]
    rows, first, second = numbered.agg(F.count(F.lit(1)), *wide).first()
    return rows, int(first), int(second)


def order_check(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Do two tables hold the same keys in the same order?

    Equal digests prove it without meeting rows. Only where they differ, positions are
    joined and the mismatches counted. Both are worked out at once, from stored positions.
    """
    a, b = (
        checkpointed(positions(df, [], order, segment_rows).select("position", F.struct(*keys).alias("__key")))
        for df in (left, right)
    )
    one, other = sequence_digest(a), sequence_digest(b)
    if one == other:
        return left.sparkSession.createDataFrame(
            [(one[0], other[0], 0)], "left_rows bigint, right_rows bigint, mismatched_positions bigint"
        )
    both = a.withColumnRenamed("__key", "__a").join(b.withColumnRenamed("__key", "__b"), "position", "full")
    return both.agg(
        F.count("__a").alias("left_rows"),
        F.count("__b").alias("right_rows"),
        F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("mismatched_positions"),
    )


def manifest_check(expected: DataFrame, actual: DataFrame, key: str = "name") -> DataFrame:
    """Files that are missing, extra or changed."""
    a = expected.select(key, F.struct("bytes", "sha256").alias("__expected"))
    b = actual.select(key, F.struct("bytes", "sha256").alias("__actual"))
    both = a.join(b, key, "full")
    status = (
        F.when(F.col("__actual").isNull(), F.lit("missing"))
        .when(F.col("__expected").isNull(), F.lit("unexpected"))
        .otherwise(F.lit("changed"))
    )
    return both.filter(~F.col("__expected").eqNullSafe(F.col("__actual"))).select(
        key, status.alias("status")
    )
