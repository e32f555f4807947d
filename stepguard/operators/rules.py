"""Threshold rules as data, compiled to columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.functions.text import fixed, render

BAND_TOLERANCE = 1e-12
MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """One strict-greater-than rule.

    ``kind`` is ``jump`` (change to the previous row) or ``level`` (the value
    itself). ``states`` limits the rule to some states; None means every state.
    ``windows`` names half-widths around the threshold.
    """

    name: str
    channel: str
    kind: str
    threshold: float
    states: tuple | None = None
    windows: dict[str, float] = field(default_factory=dict)
    unit: str = ""

    @property
    def feature(self) -> str:
        return f"{self.channel}_diff" if self.kind == "jump" else self.channel


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules kept as rows (name, channel, kind, threshold, states, windows, unit)."""
    rows = table.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [
        Rule(
            row["name"],
            row["channel"],
            row["kind"],
            row["threshold"],
            tuple(row["states"]) if row["states"] is not None else None,
            dict(row["windows"] or {}),
            row["unit"] or "",
        )
        for row in rows
    ]


def applies(rule: Rule, state: Column) -> Column:
    if rule.states is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [state.eqNullSafe(F.lit(s)) for s in rule.states])


def fires(rule: Rule, state: Column) -> Column:
    """Null and NaN values never fire."""
    value = F.col(rule.feature)
    return F.coalesce(
        applies(rule, state) & (value > F.lit(float(rule.threshold))) & ~F.isnan(value),
        F.lit(False),
    )


def add_rule_flags(df: DataFrame, rules: Sequence[Rule], state: str = "state") -> DataFrame:
    return df.withColumns({rule.name: fires(rule, F.col(state)) for rule in rules})


def any_rule(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(name) for name in names], F.lit(False))


def trigger_list(names: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name in names]))


def add_labels(df: DataFrame, rules: Sequence[Rule], state: str = "state") -> DataFrame:
    """Rule flags, the any-rule label and the trigger list."""
    names = [rule.name for rule in rules]
    flagged = add_rule_flags(df, rules, state)
    return flagged.withColumns(
        {"is_anomaly": any_rule(names), "rule_triggers": trigger_list(names)}
    )


def restricted(rules: Sequence[Rule], states: Sequence) -> list[Rule]:
    """The same rules, with the ungated ones limited to some states."""
    return [replace(r, states=tuple(states)) if r.states is None else r for r in rules]


def label_variants(
    rules: Sequence[Rule], removals: dict[str, Sequence[str]]
) -> dict[str, Column]:
    """Labels when some rules are taken out: variant name -> column over the flags."""
    names = [rule.name for rule in rules]
    return {
        variant: any_rule([n for n in names if n not in removed])
        for variant, removed in removals.items()
    }


def leave_one_out(rules: Sequence[Rule]) -> dict[str, list[str]]:
    removals: dict[str, list[str]] = {"original_all_rules": []}
    for rule in rules:
        removals[f"remove_{rule.name}"] = [rule.name]
    return removals


def variants_long(
    df: DataFrame, variants: dict[str, Column], keep: Sequence[str]
) -> DataFrame:
    """One row per record and variant."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), label.alias("variant_label"))
            for name, label in variants.items()
        ]
    )
    return df.select(*keep, F.inline(entries))


def reasons(
    rules: Sequence[Rule], templates: dict[str, str], digits: int = 4
) -> Column:
    """One sentence per rule that fired, in rule order.

    Templates may use ``{value}`` (the tested value), ``{previous}`` and
    ``{current}``.
    """
    sentences = []
    for rule in rules:
        template = templates[rule.name]
        fields = {"value": fixed(F.col(rule.feature), digits)}
        if "{previous}" in template:
            fields["previous"] = fixed(F.col(f"previous_{rule.channel}"), digits)
        if "{current}" in template:
            fields["current"] = fixed(F.col(rule.channel), digits)
        sentences.append(F.when(F.col(rule.name), render(template, fields)))
    return F.array_compact(F.array(*sentences))


def reason_text(found: Column, separator: str, nothing: str) -> Column:
    return F.when(F.size(found) > 0, F.array_join(found, separator)).otherwise(F.lit(nothing))


def state_bucket(state: Column, names: dict, other: str) -> Column:
    bucket = F.lit(other)
    for value, name in names.items():
        bucket = F.when(state.eqNullSafe(F.lit(value)), F.lit(name)).otherwise(bucket)
    return bucket


def threshold_side(value: Column, threshold: float | Column) -> Column:
    return F.when(value <= threshold, F.lit("below_or_equal")).when(
        value > threshold, F.lit("above")
    )


def in_band(value: Column, threshold: float | Column, width: float | Column) -> Column:
    """Within the half-width of the threshold, with a tolerance for binary rounding."""
    if not isinstance(width, Column):
        width = F.lit(float(width))
    return F.coalesce(F.abs(value - threshold) <= width + F.lit(BAND_TOLERANCE), F.lit(False))


def band_members(
    df: DataFrame, rules: Sequence[Rule], keep: Sequence[str], state: str = "state"
) -> DataFrame:
    """One row for each (record, rule, window) whose value lies in the band.

    The rule list is part of the plan, so nothing is joined; a record that is
    near no threshold produces no rows.
    """
    hits = []
    for rule in rules:
        value = F.col(rule.feature)
        for window, width in rule.windows.items():
            entry = F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(window).alias("window_name"),
                F.lit(rule.feature).alias("feature"),
                value.alias("feature_value"),
                F.lit(float(rule.threshold)).alias("threshold"),
                F.lit(float(width)).alias("half_width"),
                F.abs(value - F.lit(float(rule.threshold))).alias("distance"),
                threshold_side(value, F.lit(float(rule.threshold))).alias("side"),
            )
            near = applies(rule, F.col(state)) & in_band(value, F.lit(float(rule.threshold)), width)
            hits.append(F.when(near, entry))
    return df.select(*keep, F.inline(F.array_compact(F.array(*hits))))


def other_triggers(triggers: Column, rule: Column) -> Column:
    return F.array_remove(triggers, rule)


def isolated(triggers: Column, rule: Column) -> Column:
    """No rule besides the target fired."""
    return F.size(other_triggers(triggers, rule)) == 0
