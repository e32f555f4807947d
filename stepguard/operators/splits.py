"""Group-isolated train / validation / test splits and their audits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.functions.hashing import MODULUS, mixed_integer, mixed_integers, seeded_integer
from stepguard.functions.numbers import rate
from stepguard.operators.ordered import SEGMENT_ROWS, running_totals
from stepguard.session import broadcast_if_small

SPLITS = ["train", "val", "test"]
# Fixed value: the seed of the published split.
SEARCH_SEED = 20260725
#: Groups and trials whose draws are held at a time.
GROUPS_HELD, TRIALS_HELD = 64, 2048


def split_by_share(key: Column, shares: dict[str, float]) -> Column:
    """Split of a hex key by its first 32 bits; the last split takes the rest."""
    *front, last = list(shares)
    bounds, upto = [], 0.0
    for name in front:
        upto += shares[name]
        bounds.append((name, f"{min(int(upto * 2**32), 2**32 - 1):08x}"))
    out = F.lit(last)
    for name, bound in reversed(bounds):
        out = F.when(F.substring(key, 1, 8) < bound, F.lit(name)).otherwise(out)
    return out


def chronological_split(
    profiles: DataFrame,
    first_id: str,
    rows: str,
    train_share: float = 0.70,
    val_until: float = 0.85,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Whole groups in time order, cut where the row count is nearest to the targets.

    Of two equally near cuts the later one is taken. Targets are rounded half
    to even. The result has the running row count in ``cumulative``.
    """
    ordered = running_totals(
        profiles, [], [first_id], {"cumulative": F.col(rows)}, segment_rows=segment_rows
    )
    total = profiles.agg(F.sum(rows)).scalar()

    def nearest(share: float, start: Column) -> DataFrame:
        target = F.bround(total * F.lit(share), 0)
        # The cut may also lie at the start, before any further group.
        candidates = F.explode(F.array(F.col("cumulative"), start)).alias("cut")
        return ordered.select(candidates).filter(F.col("cut") >= start).agg(
            F.min_by("cut", F.struct(F.abs(F.col("cut") - target), -F.col("cut")))
        )

    first_cut = nearest(train_share, F.lit(0).cast("bigint")).scalar()
    second_cut = nearest(val_until, first_cut).scalar()
    split = (
        F.when(F.col("cumulative") <= first_cut, F.lit("train"))
        .when(F.col("cumulative") <= second_cut, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return ordered.withColumn("split", split)


def chosen_in(base: Column, trial: Column, probability: float) -> Column:
    """Whether a trial selects the group with this base; every group and trial has a draw of its own."""
    return mixed_integer(base, trial).cast("double") / F.lit(float(MODULUS)) < F.lit(probability)


def _first_beyond(probability: float) -> int:
    """The smallest whole number that :func:`chosen_in` doesn't take as a draw."""
    bound = int(probability * MODULUS)
    while bound / float(MODULUS) < probability:
        bound += 1
    while bound and (bound - 1) / float(MODULUS) >= probability:
        bound -= 1
    return bound


def trial_scores(
    groups: DataFrame,
    trials: int,
    probability: float,
    target_total: Column,
    target_rate: Column,
) -> DataFrame:
    """Score of each random group selection; lower is better.

    ``groups`` has (base, total, anomaly). Selections come from a hash of group and trial
    (:func:`chosen_in`), so no trial has to be stored. A task adds its groups up in three
    vectors of ``trials`` numbers, some groups and trials at a time, and passes these on, so
    no row of groups times trials exists and at most ``trials`` rows leave each task.
    """
    bound = _first_beyond(probability)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, trial = np.zeros((3, trials), dtype=np.int64), np.arange(trials, dtype=np.int64)
        for batch in batches:
            rows = batch[["base", "total", "anomaly"]].to_numpy(np.int64)
            for first in range(0, len(rows), GROUPS_HELD):
                part = rows[first : first + GROUPS_HELD]
                weights = np.vstack([np.ones(len(part), dtype=np.int64), part[:, 1], part[:, 2]])
                exact = np.float64 if np.abs(weights).sum(axis=1).max() < 2**53 else np.int64
                weights = weights.astype(exact)
                for at in range(0, trials, TRIALS_HELD):
                    held = slice(at, at + TRIALS_HELD)
                    chosen = mixed_integers(part[:, :1], trial[None, held]) < bound
                    sums[:, held] += (weights @ chosen.astype(exact)).astype(np.int64)
        found = np.flatnonzero(sums[0])
        yield pd.DataFrame(dict(zip(("groups", "total", "anomaly"), sums[:, found]), trial=found.astype(np.int32)))

    # a given number of tasks: few rows are much work here, so Spark must not put them together
    tasks = groups.sparkSession.sparkContext.defaultParallelism
    partial = (
        groups.select("base", "total", "anomaly")
        .repartition(tasks)
        .mapInPandas(summed, "groups bigint, total bigint, anomaly bigint, trial int")
    )
    added = partial.groupBy("trial").agg(*[F.sum(c).alias(c) for c in ("groups", "total", "anomaly")])
    wanted = target_total * target_rate
    chosen_rate = F.col("anomaly") / F.col("total")
    score = (
        2.0 * F.abs(F.col("total") - target_total) / target_total
        + 4.0 * F.try_divide(F.abs(chosen_rate - target_rate), target_rate)
        + F.try_divide(F.abs(F.col("anomaly") - wanted), wanted)
    )
    return added.filter("groups >= 2").withColumn("score", score)


def best_trial(scores: DataFrame) -> DataFrame:
    """The trial with the lowest score; the earliest one wins a tie.

    Trials without a score don't take part; if none has one, the job stops.
    """
    best = scores.filter("score IS NOT NULL").agg(
        F.min_by("trial", F.struct("score", "trial")).alias("trial")
    )
    failed = F.raise_error(F.lit("no trial selects two groups and has a score")).cast("int")
    return best.select(F.coalesce("trial", failed).alias("trial"))


def stratified_group_split(
    profiles: DataFrame,
    group: str,
    trials: int = 60_000,
    share: float = 0.15,
    seed: int = SEARCH_SEED,
) -> DataFrame:
    """Search for test and validation groups that match size and positive rate.

    The test groups are chosen first, the validation groups from the rest.
    ``profiles`` has (group, total, anomaly) and is read several times, so pass
    a stored frame.
    """
    sums = profiles.agg(F.sum("total").alias("t"), F.sum("anomaly").alias("a"))
    overall = sums.select(F.struct("t", "a")).scalar()
    target_total = overall["t"] * F.lit(share)
    target_rate = overall["a"] / overall["t"]

    def search(pool: DataFrame, name: str, probability: float) -> tuple[DataFrame, Column]:
        based = pool.withColumn("base", seeded_integer(f"{seed}-{name}", F.col(group)))
        scores = trial_scores(based, trials, probability, target_total, target_rate)
        trial = best_trial(scores).scalar().cast("bigint")
        return based, chosen_in(F.col("base"), trial, probability)

    based, in_test = search(profiles, "test", share)
    marked = based.withColumn("__test", in_test).drop("base")
    rest, in_val = search(marked.filter(~F.col("__test")), "val", share / (1 - share))
    held_out = marked.filter("__test").withColumn("split", F.lit("test"))
    others = rest.withColumn(
        "split", F.when(in_val, F.lit("val")).otherwise(F.lit("train"))
    ).drop("base")
    return held_out.unionByName(others).drop("__test")


def with_split(df: DataFrame, design: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Look up the split of each record's group; an unknown group stops the job."""
    lookup = design.select(F.col(group).alias("__group"), F.col(split).alias("__split"))
    joined = df.join(broadcast_if_small(lookup), F.col(group) == F.col("__group"), "left")
    unknown = F.raise_error(
        F.concat(F.lit("group absent from split design: "), F.col(group).cast("string"))
    ).cast("string")
    return joined.withColumn(split, F.coalesce("__split", unknown)).drop("__group", "__split")


def adjacent_pairs(selected: DataFrame, record_id: str, split: str) -> DataFrame:
    """Selected records whose ids follow each other directly, by pair of splits.

    Ids are unique, so a join on ``id + 1`` finds each neighbour without
    ordering the whole table.
    """
    left = selected.select((F.col(record_id) + 1).alias("__next"), F.col(split).alias("left_split"))
    right = selected.select(F.col(record_id).alias("__next"), F.col(split).alias("right_split"))
    return left.join(right, "__next").groupBy("left_split", "right_split").agg(
        F.count(F.lit(1)).alias("pairs")
    )


def cross_split_rate(pairs: DataFrame) -> DataFrame:
    crossing = F.when(F.col("left_split") != F.col("right_split"), F.col("pairs"))
    summed = pairs.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("adjacent_pairs"),
        F.coalesce(F.sum(crossing), F.lit(0)).alias("cross_split_pairs"),
    )
    return summed.withColumn(
        "cross_split_rate", rate(F.col("cross_split_pairs"), F.col("adjacent_pairs"), 0.0)
    )


def split_ranges(
    df: DataFrame, split: str, label: str, record_id: str, time: str
) -> DataFrame:
    """Counts and id/time ranges per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label)).alias("anomaly"),
        F.count_if(~F.col(label)).alias("normal"),
        F.min(record_id).alias("min_record_id"),
        F.max(record_id).alias("max_record_id"),
        F.min(time).alias("min_timestamp"),
        F.max(time).alias("max_timestamp"),
    )


def group_presence(
    df: DataFrame, group: str, split: str, label: str, splits: Sequence[str] = SPLITS
) -> DataFrame:
    """Per group: size, positives, positive rate and the named splits it occurs in."""
    named = F.when(F.col(split).isin(list(splits)), F.col(split))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label)).alias("anomaly"),
        F.sort_array(F.collect_set(named)).alias("selected_splits"),
    ).withColumn("anomaly_rate", rate(F.col("anomaly"), F.col("total"), 0.0))


def leakage_summary(presence: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    held = F.size("selected_splits")
    return presence.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(held >= 2).alias("groups_in_multiple_splits"),
        F.count_if(held == len(splits)).alias("groups_in_all_splits"),
        F.count_if(F.col("anomaly") > 0).alias("groups_with_anomalies"),
    )


def natural_order(name: str, last: int = 1_000_000_000) -> Column:
    """Sort key for group names: digits by value, everything else at the end."""
    text = F.col(name).cast("string")
    return F.when(text.rlike("^[0-9]+$"), F.coalesce(text.try_cast("bigint"), F.lit(last))).otherwise(
        F.lit(last)
    )


def set_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many distinct keys two one-column frames share."""
    return left.intersect(right).agg(F.count(F.lit(1)).alias("shared"))


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the left frame that the right one lacks."""
    return left.join(right, list(keys), "left_anti")


def pairwise_overlap(df: DataFrame, split: str, key: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Keys shared by each pair of splits, from one grouping by key."""
    held = df.groupBy(key).agg(F.collect_set(split).alias("held"))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    counts = held.agg(
        *[
            F.count_if(F.array_contains("held", a) & F.array_contains("held", b)).alias(f"{a}|{b}")
            for a, b in pairs
        ]
    )
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("shared"))
            for a, b in pairs
        ]
    )
    return counts.select(F.inline(entries))


def first_examples(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int
) -> DataFrame:
    """The first k records per key. Spark keeps only k per task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(window))
        .filter(F.col("__rank") <= k)
        .drop("__rank")
    )
