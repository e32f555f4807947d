"""Data-validity profiles.

Row-level data is aggregated once at the finest grain that a report needs.
Totals over all splits, and the zero cells of a dense report, are added to that
small result afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from stepguard.functions.numbers import rate
from stepguard.operators.ordered import SEGMENT_ROWS, exact_quantiles
from stepguard.operators.rules import Rule, band_members

ALL = "all"


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def zero_grid(df: DataFrame, axes: dict[str, Sequence], measures: Sequence[str]) -> DataFrame:
    rows = [values + (0,) * len(measures) for values in product(*axes.values())]
    schema = ", ".join([f"`{a}` string" for a in axes] + [f"`{m}` bigint" for m in measures])
    return df.sparkSession.createDataFrame(rows, schema)


def _dense_with_total(
    counts: DataFrame, axes: dict[str, Sequence], split: str, measures: Sequence[str]
) -> DataFrame:
    """Add the missing cells as zeros, then the total over all splits."""
    filled = counts.select(*axes, *measures).unionByName(zero_grid(counts, axes, measures))
    doubled = filled.withColumn(split, F.explode(F.array(F.col(split), F.lit(ALL))))
    return doubled.groupBy(*axes).agg(*[F.sum(m).alias(m) for m in measures])


def group_profile(
    df: DataFrame, group: str, record_id: str, time: str, label: str
) -> DataFrame:
    """One row per group: size, positives, id and time range."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        _count(F.col(label)).alias("anomaly"),
        F.min(record_id).alias("first_record_id"),
        F.max(record_id).alias("last_record_id"),
        F.min(time).alias("min_timestamp"),
        F.max(time).alias("max_timestamp"),
    )


def split_statistics(profiles: DataFrame, split: str = "split") -> DataFrame:
    """Split summary from group profiles."""
    summed = profiles.groupBy(split).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("total").alias("total"),
        F.sum("anomaly").alias("anomaly"),
        F.min("first_record_id").alias("first_record_id"),
        F.max("last_record_id").alias("last_record_id"),
        F.min("min_timestamp").alias("min_timestamp"),
        F.max("max_timestamp").alias("max_timestamp"),
    )
    normal = F.col("total") - F.col("anomaly")
    return summed.withColumns(
        {
            "normal": normal,
            "anomaly_rate": rate(F.col("anomaly"), F.col("total"), 0.0),
            "balanced_subset_size": 2 * F.least(F.col("anomaly"), normal),
        }
    )


def state_distribution(
    df: DataFrame, split: str, bucket: str, splits: Sequence[str], buckets: Sequence[str]
) -> DataFrame:
    counts = df.groupBy(split, bucket).agg(F.count(F.lit(1)).alias("n"))
    dense = _dense_with_total(counts, {split: splits, bucket: buckets}, split, ["n"])
    whole = F.sum("n").over(Window.partitionBy(split))
    return dense.withColumn("proportion", rate(F.col("n"), whole))


def trigger_counts(
    df: DataFrame, names: Sequence[str], split: str, splits: Sequence[str]
) -> DataFrame:
    """How often each rule fired, per split and overall."""
    wide = df.groupBy(split).agg(*[_count(F.col(name)).alias(name) for name in names])
    entries = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("triggered")) for n in names]
    )
    long = wide.select(split, F.inline(entries))
    return _dense_with_total(long, {split: splits, "rule": names}, split, ["triggered"])


def unique_trigger_counts(df: DataFrame, triggers: str, names: Sequence[str]) -> DataFrame:
    """Records on which exactly one rule fired, per rule."""
    single = df.filter(F.size(triggers) == 1).select(F.element_at(triggers, 1).alias("rule"))
    counts = single.groupBy("rule").agg(F.count(F.lit(1)).alias("unique_triggers"))
    zero = zero_grid(df, {"rule": names}, ["unique_triggers"])
    return counts.unionByName(zero).groupBy("rule").agg(
        F.sum("unique_triggers").alias("unique_triggers")
    )


def overlap(df: DataFrame, first: str, second: str) -> DataFrame:
    a, b = F.col(first), F.col(second)
    return df.agg(
        _count(a).alias("first_trigger"),
        _count(b).alias("second_trigger"),
        _count(a & b).alias("both"),
        _count(a & ~b).alias("first_only"),
        _count(b & ~a).alias("second_only"),
    )


def redundancy(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """How far two columns repeat each other; one row per named pair."""
    aggregates = []
    for name, (left, right) in pairs.items():
        gap = F.col(left) - F.col(right)
        aggregates.append(
            F.struct(
                F.lit(name).alias("pair"),
                F.count(gap).alias("pairs"),
                _count(gap == 0.0).alias("exact_equal"),
                F.max(F.abs(gap)).alias("max_abs_difference"),
            ).alias(f"__{name}")
        )
    wide = df.agg(*aggregates)
    long = wide.select(F.inline(F.array(*[F.col(f"`__{name}`") for name in pairs])))
    return long.withColumn("exact_equal_rate", rate(F.col("exact_equal"), F.col("pairs")))


def threshold_coverage(
    df: DataFrame,
    rules: Sequence[Rule],
    split: str,
    bucket: str,
    label: str,
    splits: Sequence[str],
    buckets: Sequence[str],
    state: str = "state",
) -> DataFrame:
    """Records near each threshold: rule x window x split, zero cells kept."""
    near = band_members(df, rules, [split, bucket, label], state)
    measures = {
        "total": F.lit(True),
        "below_or_equal": F.col("side") == "below_or_equal",
        "above": F.col("side") == "above",
        "label_normal": ~F.col(label),
        "label_anomaly": F.col(label),
    }
    measures |= {f"state_{name}": F.col(bucket) == name for name in buckets}
    counts = near.groupBy("rule", "window_name", split).agg(
        *[_count(condition).alias(name) for name, condition in measures.items()]
    )
    windows = sorted({w for rule in rules for w in rule.windows})
    dense = _dense_with_total(
        counts,
        {"rule": [r.name for r in rules], "window_name": windows, split: splits},
        split,
        list(measures),
    )
    spec = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(w).alias("window_name"),
                F.lit(r.feature).alias("feature"),
                F.lit(float(r.threshold)).alias("threshold"),
                F.lit(float(width)).alias("half_width"),
            )
            for r in rules
            for w, width in r.windows.items()
        ]
    )
    own = F.filter(
        spec, lambda s: (s["rule"] == F.col("rule")) & (s["window_name"] == F.col("window_name"))
    )
    return dense.withColumn("__spec", F.get(own, F.lit(0))).filter("__spec IS NOT NULL").select(
        "rule",
        "window_name",
        split,
        *measures,
        F.col("__spec.feature").alias("feature"),
        F.col("__spec.threshold").alias("threshold"),
        F.col("__spec.half_width").alias("half_width"),
    )


def sensitivity(
    df: DataFrame,
    variants: dict[str, Column],
    original: str,
    split: str,
    splits: Sequence[str],
) -> DataFrame:
    """Effect of taking rules out, per split and overall.

    ``changed_counts`` compares the number of positives, ``changed_rows`` counts
    the records whose label differs.
    """
    base = variants[original]
    aggregates = [_count(base).alias("__base")]
    for name, label in variants.items():
        aggregates.append(_count(label).alias(f"p_{name}"))
        aggregates.append(_count(label != base).alias(f"c_{name}"))
    wide = df.groupBy(split).agg(*aggregates)
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                F.col(f"p_{name}").alias("positive_labels"),
                F.col(f"c_{name}").alias("changed_rows"),
                F.col("__base").alias("original_labels"),
            )
            for name in variants
        ]
    )
    long = wide.select(split, F.inline(entries))
    measures = ["positive_labels", "changed_rows", "original_labels"]
    dense = _dense_with_total(long, {split: splits, "variant": list(variants)}, split, measures)
    direction = F.col("positive_labels") - F.col("original_labels")
    return dense.withColumns(
        {"changed_counts": F.abs(direction), "change_direction": direction}
    ).drop("original_labels")


QUANTILES = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}


def distribution(
    df: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    levels: dict[str, float] = QUANTILES,
    approximate: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Count, range, mean, population deviation and quantiles per feature.

    Features without any value keep a row of nulls. ``approximate`` replaces
    the exact quantiles by the built-in sketch, which needs no ordered pass.
    """
    by = list(by)
    aggregates = []
    for name in features:
        c = F.col(name)
        fields = [
            F.lit(name).alias("feature"),
            F.count(c).alias("n"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.avg(c).alias("mean"),
            F.stddev_pop(c).alias("std"),
        ]
        if approximate:
            sketch = F.percentile_approx(c, F.array(*[F.lit(q) for q in levels.values()]), 10_000)
            fields += [F.get(sketch, F.lit(i)).alias(q) for i, q in enumerate(levels)]
        aggregates.append(F.struct(*fields).alias(f"__{name}"))
    wide = df.groupBy(*by).agg(*aggregates)
    moments = wide.select(*by, F.inline(F.array(*[F.col(f"`__{name}`") for name in features])))
    if approximate:
        return moments
    entries = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(n).alias("__value")) for n in features]
    )
    long = df.select(*by, F.inline(entries))
    quantiles = exact_quantiles(long, [*by, "feature"], "__value", levels, segment_rows)
    return moments.join(quantiles, [*by, "feature"], "left")


def pearson(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Correlation matrix over complete rows, in one pass.

    A constant feature has no correlation; its cells are null. It is recognised
    by its range, since the deviation of merged partial results is not exactly zero.
    """
    complete = df
    for name in features:
        complete = complete.filter(F.col(name).isNotNull())
    names = list(features)
    aggregates = [
        F.when(F.min(name) < F.max(name), F.stddev_pop(name)).alias(f"s_{name}") for name in names
    ]
    for i, a in enumerate(names):
        aggregates += [F.covar_pop(a, b).alias(f"c_{a}|{b}") for b in names[i + 1 :]]
    moments = complete.groupBy(*by).agg(*aggregates)

    def cell(a: str, b: str) -> Column:
        if a == b:
            value = F.when(F.col(f"s_{a}") > 0, F.lit(1.0))
        else:
            first, second = sorted((a, b), key=names.index)
            spread = F.col(f"s_{a}") * F.col(f"s_{b}")
            value = F.when(spread > 0, F.try_divide(F.col(f"`c_{first}|{second}`"), spread))
        return F.struct(
            F.lit(a).alias("row_feature"), F.lit(b).alias("column_feature"), value.alias("pearson_r")
        )

    return moments.select(*by, F.inline(F.array(*[cell(a, b) for a in names for b in names])))


def missing_counts(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Nulls per field."""
    wide = df.groupBy(*by).agg(*[_count(F.col(f).isNull()).alias(f) for f in fields])
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields]
    )
    return wide.select(*by, F.inline(entries))


def length_summary(
    df: DataFrame,
    text: str,
    by: Sequence[str] = (),
    limit: int | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Length statistics of a text column; ``truncated`` counts texts above a limit."""
    by = list(by)
    sized = df.select(*by, F.length(text).cast("double").alias("__length"))
    over = F.lit(False) if limit is None else F.col("__length") > limit
    summary = sized.groupBy(*by).agg(
        F.min("__length").alias("min"),
        F.max("__length").alias("max"),
        F.avg("__length").alias("mean"),
        _count(over).alias("truncated"),
    )
    levels = {"p95": 0.95, "p99": 0.99}
    quantiles = exact_quantiles(sized, by, "__length", levels, segment_rows)
    return _beside(summary, quantiles, by)


def run_log_summary(
    df: DataFrame, by: Sequence[str], value: str, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Repeat-run statistics; a single run has deviation zero."""
    by = list(by)
    summary = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("runs"),
        F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    levels = {"median": 0.5, "p95": 0.95}
    return _beside(summary, exact_quantiles(df, by, value, levels, segment_rows), by)


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join two reports with one row per key; both have one row when there is no key."""
    if by:
        return left.join(right, by, "left")
    key = F.lit(1).alias("__one")
    return left.select("*", key).join(right.select("*", key), "__one", "left").drop("__one")


def label_audit(df: DataFrame, stored: str, variants: dict[str, str]) -> DataFrame:
    """Positives per label definition, and mismatches with the stored label."""
    aggregates = [F.count(F.lit(1)).alias("total"), _count(F.col(stored)).alias("stored_anomaly")]
    names = list(variants.items())
    for name, column in names:
        aggregates.append(_count(F.col(column)).alias(f"{name}_anomaly"))
        aggregates.append(
            _count(F.col(column) != F.col(stored)).alias(f"stored_vs_{name}_mismatch")
        )
    for (a, left), (b, right) in zip(names, names[1:]):
        aggregates.append(_count(F.col(left) != F.col(right)).alias(f"{a}_vs_{b}_mismatch"))
    return df.agg(*aggregates)


def anomaly_rate(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        _count(F.col(label)).alias("anomalies"),
    ).withColumn("anomaly_percent", 100 * rate(F.col("anomalies"), F.col("total")))


def feature_statistics(
    df: DataFrame, sequence: str, names: Sequence[str], floor: float = 1e-6
) -> DataFrame:
    """Mean and population deviation per feature over all steps of all sequences.

    Each step is turned into one aggregate input, so the feature axis is never
    exploded; a deviation below ``floor`` counts as one.
    """
    steps = df.select(F.explode(sequence).alias("step"))
    aggregates = [
        F.struct(
            F.lit(name).alias("feature"),
            F.avg(F.element_at("step", i + 1)).alias("mean"),
            F.stddev_pop(F.element_at("step", i + 1)).alias("raw_std"),
        ).alias(f"f{i}")
        for i, name in enumerate(names)
    ]
    wide = steps.agg(*aggregates)
    long = wide.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(names))])))
    std = F.when(F.col("raw_std") < floor, F.lit(1.0)).otherwise(F.col("raw_std"))
    return long.select("feature", "mean", std.alias("std"))


def normalised(
    df: DataFrame, sequence: str, statistics: DataFrame, names: Sequence[str], out: str
) -> DataFrame:
    """Apply feature statistics to sequences.

    The statistics have one row per feature, so they are read as one scalar.
    """
    order = F.array(*[F.lit(n) for n in names])
    packed = statistics.agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.array_position(order, F.col("feature")).alias("at"), "mean", "std")
            )
        ).alias("all")
    )
    table = df.withColumn("__stats", packed.scalar())
    scaled = F.transform(
        sequence,
        lambda step: F.zip_with(
            step, F.col("__stats"), lambda value, s: (value - s["mean"]) / s["std"]
        ),
    )
    return table.withColumn(out, scaled).drop("__stats")
