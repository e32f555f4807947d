"""Near-threshold stress cases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepguard.operators.rules import Rule


@dataclass(frozen=True)
class CaseFamily:
    """A grid of base x delta x state for one channel.

    ``linked`` channels move together with the channel itself. For kind
    ``level`` the base is zero and the delta is the value, without a change.
    ``idle`` gives the value of every channel that does not move.
    """

    case_type: str
    channel: str
    kind: str
    states: tuple
    bases: tuple[float, ...]
    deltas: tuple[float, ...]
    idle: dict[str, float]
    linked: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        return len(self.states) * len(self.bases) * len(self.deltas)


def case_grid(
    spark: SparkSession,
    families: Sequence[CaseFamily],
    channels: Sequence[str],
    first_id: int,
) -> DataFrame:
    """All cases of a family list, with ids in the order of the lists.

    Gives record_id, case_type, state, and current and previous value of every
    channel. Values keep the binary rounding of ``base + delta``.
    """
    rows, start = [], first_id
    for family in families:
        rows.append(
            (
                start,
                family.case_type,
                family.channel,
                family.kind,
                list(family.states),
                [float(b) for b in family.bases],
                [float(d) for d in family.deltas],
                [family.channel, *family.linked],
                {k: float(v) for k, v in family.idle.items()},
            )
        )
        start += family.size
    schema = (
        "start bigint, case_type string, channel string, kind string, states array<int>, "
        "bases array<double>, deltas array<double>, moving array<string>, idle map<string,double>"
    )
    specs = spark.createDataFrame(rows, schema)
    grid = (
        specs.select("*", F.posexplode("states").alias("i", "state"))
        .select("*", F.posexplode("bases").alias("j", "base"))
        .select("*", F.posexplode("deltas").alias("k", "delta"))
    )
    place = (F.col("i") * F.size("bases") + F.col("j")) * F.size("deltas") + F.col("k")
    moves = F.col("kind") == "jump"
    columns = [
        (F.col("start") + place).alias("record_id"),
        "case_type",
        "state",
    ]
    for name in channels:
        touched = F.array_contains("moving", name)
        idle = F.element_at("idle", F.lit(name))
        current = F.when(moves, F.col("base") + F.col("delta")).otherwise(F.col("delta"))
        previous = F.when(moves, F.col("base")).otherwise(F.col("delta"))
        columns.append(F.when(touched, current).otherwise(idle).alias(name))
        columns.append(F.when(touched, previous).otherwise(idle).alias(f"previous_{name}"))
    return grid.select(*columns)


def near_threshold_cases(
    base: DataFrame,
    rules: Sequence[Rule],
    offsets: Sequence[float],
    states: Sequence,
    channels: Sequence[str],
    keep: Sequence[str],
) -> DataFrame:
    """Cases just below, on and above every threshold, started from real rows.

    ``base`` has one value per channel. A jump rule starts from that value; a
    level rule sets it. States outside the gate give the cases in which the
    rule must stay silent.
    """
    entries = []
    for rule in rules:
        for offset in offsets:
            for state in states:
                gated = rule.states is None or state in rule.states
                entries.append(
                    F.struct(
                        F.lit(rule.name).alias("rule"),
                        F.lit(
                            f"{rule.name}_boundary" if gated else f"{rule.name}_applicability"
                        ).alias("case_type"),
                        F.lit(rule.channel).alias("channel"),
                        F.lit(rule.kind == "jump").alias("moves"),
                        F.lit(float(rule.threshold)).alias("threshold"),
                        F.lit(float(offset)).alias("offset"),
                        F.lit(state).alias("state"),
                    )
                )
    spread = base.select(*keep, *channels, F.inline(F.array(*entries)))
    target = F.col("threshold") + F.col("offset")
    columns: dict[str, Column] = {}
    for name in channels:
        touched = F.col("channel") == name
        moved = F.when(F.col("moves"), F.col(name) + target).otherwise(target)
        start = F.when(F.col("moves"), F.col(name)).otherwise(target)
        columns[f"__now_{name}"] = F.when(touched, moved).otherwise(F.col(name))
        columns[f"previous_{name}"] = F.when(touched, start).otherwise(F.col(name))
    out = spread.withColumns(columns)
    return out.withColumns({name: F.col(f"__now_{name}") for name in channels}).drop(
        *[f"__now_{name}" for name in channels], "channel", "moves"
    )
