"""Previous rows, adjacent differences and short histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.operators.ordered import SEGMENT_ROWS, over_history


def add_previous(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    channels: Sequence[str],
    prefix: str = "previous_",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The value in the row just before, also when that value is null.

    The first row of a group has no previous value. An empty ``group`` takes
    the previous row of the whole table, which is the older labelling.
    """
    return over_history(
        df,
        group,
        order,
        1,
        lambda w: {f"{prefix}{name}": F.lag(name).over(w) for name in channels},
        segment_rows,
    )


def add_differences(
    df: DataFrame, channels: Sequence[str], prefix: str = "previous_", suffix: str = "_diff"
) -> DataFrame:
    """Absolute change to the previous row; null when either side is null."""
    return df.withColumns(
        {
            f"{name}{suffix}": F.abs(F.col(name) - F.col(f"{prefix}{name}"))
            for name in channels
        }
    )


def add_steps(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    channels: Sequence[str],
    prefix: str = "previous_",
    suffix: str = "_diff",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Previous values and absolute differences in one window pass."""
    previous = add_previous(df, group, order, channels, prefix, segment_rows)
    return add_differences(previous, channels, prefix, suffix)


def channel_family(df: DataFrame, marker: str) -> list[str]:
    """All columns whose name contains the marker, in table order."""
    return [name for name in df.columns if marker in name]


def channel_jumps(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    channels: Sequence[str],
    threshold: float,
    out: str = "jumps",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Every channel of a wide family whose jump is above one threshold.

    The channels travel as one array, so the rows are ordered once and not
    once per channel. ``out`` is an array of (channel, previous, value, jump).
    """
    packed = df.withColumn("__channels", F.array(*[F.col(f"`{c}`") for c in channels]))
    shifted = add_previous(packed, group, order, ["__channels"], "__before", segment_rows)
    return shifted.withColumn(
        out, jumps_between("__before__channels", "__channels", channels, threshold)
    ).drop("__channels", "__before__channels")


def jumps_between(
    previous: str, current: str, names: Sequence[str], threshold: float
) -> Column:
    """Array elements that moved by more than the threshold between two arrays."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.lit(len(names))),
        lambda i: F.struct(
            F.element_at(F.array(*[F.lit(n) for n in names]), i).alias("channel"),
            F.element_at(F.col(previous), i).alias("previous"),
            F.element_at(F.col(current), i).alias("value"),
            F.abs(F.element_at(F.col(current), i) - F.element_at(F.col(previous), i)).alias(
                "jump"
            ),
        ),
    )
    found = F.filter(pairs, lambda p: (p["jump"] > threshold) & ~F.isnan(p["jump"]))
    return F.when(F.col(previous).isNotNull(), found).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def rolling_sequence(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    step: Column,
    length: int = 8,
    out: str = "sequence",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The last ``length`` steps up to each row, oldest first.

    A short history is filled on the left with its oldest step.
    """
    packed = df.withColumn("__step", step)
    history = over_history(
        packed,
        group,
        order,
        length - 1,
        lambda w: {out: F.collect_list("__step").over(w.rowsBetween(-(length - 1), 0))},
        segment_rows,
    )
    return history.withColumn(out, left_padded(F.col(out), length)).drop("__step")


def left_padded(sequence: Column, length: int) -> Column:
    return F.concat(
        F.array_repeat(F.element_at(sequence, 1), F.lit(length) - F.size(sequence)), sequence
    )


def repeated_previous(previous: Column, current: Column, length: int = 8) -> Column:
    """The previous step repeated, then the current one."""
    return F.concat(F.array_repeat(previous, length - 1), F.array(current))
