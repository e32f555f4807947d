"""Feature vectors for tabular models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.functions.numbers import one_hot, or_zero, previous_or_current


def feature_names(channels: Sequence[str], states: Sequence) -> list[str]:
    """Names of the feature columns, in vector order."""
    names = [f"state_{value}" for value in states] + ["state_other"]
    for name in channels:
        names += [f"f_{name}", f"f_previous_{name}", f"f_{name}_diff"]
    return names + ["has_previous"]


def feature_columns(
    channels: Sequence[str], states: Sequence, state: str = "state"
) -> dict[str, Column]:
    """State flags, then (value, previous, change) per channel, then a history flag.

    A missing value is zero; a missing previous value is the current one.
    """
    columns = one_hot(F.col(state), list(states), "state")
    for name in channels:
        now, before = F.col(name), F.col(f"previous_{name}")
        columns[f"f_{name}"] = or_zero(now)
        columns[f"f_previous_{name}"] = previous_or_current(before, now)
        columns[f"f_{name}_diff"] = or_zero(F.col(f"{name}_diff"))
    complete = F.lit(True)
    for name in channels:
        complete = complete & F.col(f"previous_{name}").isNotNull()
    columns["has_previous"] = complete.cast("double")
    return columns


def assemble(df: DataFrame, columns: dict[str, Column], out: str = "features") -> DataFrame:
    """All features as one array, in the given order."""
    return df.withColumn(out, F.array(*[c.cast("double") for c in columns.values()]))


def standardised(
    df: DataFrame, features: str, size: int, fit_on: Column, out: str
) -> DataFrame:
    """Scale by mean and population deviation of the rows that meet ``fit_on``.

    A constant feature is only centred. It is recognised by its range, since the
    deviation of merged partial results is not exactly zero. The statistics are
    one row.
    """
    sample = df.filter(fit_on)

    def statistics(i: int) -> Column:
        value = F.get(F.col(features), F.lit(i))
        spread = F.when(F.min(value) < F.max(value), F.stddev_pop(value)).otherwise(F.lit(1.0))
        return F.struct(F.avg(value).alias("mean"), spread.alias("std"))

    stats = sample.agg(F.array(*[statistics(i) for i in range(size)]).alias("stats"))
    table = df.withColumn("__stats", stats.scalar())
    scaled = F.zip_with(
        F.col(features), F.col("__stats"), lambda x, s: (x - s["mean"]) / s["std"]
    )
    return table.withColumn(out, scaled).drop("__stats")
