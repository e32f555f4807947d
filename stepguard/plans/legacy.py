"""The first labelling of cycler tables: previous row of the whole table, all cells.

The texts and the task description below are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepguard.functions.numbers import typed_channels
from stepguard.functions.text import fixed, named_values, render
from stepguard.operators.adjacent import add_differences, channel_family, jumps_between
from stepguard.operators.ordered import SEGMENT_ROWS, over_history
from stepguard.operators.rules import add_rule_flags, reasons
from stepguard.operators.stage import computed_once
from stepguard.plans import cycler as cy

# ---- fixed values ----------------------------------------------------------

WHOLE_REASONS = {
    "charge_total_jump": "充电时总电压跳变过大（上一行{previous}V→本行{current}V，跳变{value}V > 阈值3.0V）",
    "discharge_total_limit": "放电时总电压超过最大阈值（{value}V > 阈值378.2V）",
    "charge_current_jump": "充电时电流跳变过大（上一行{previous}A→本行{current}A，跳变{value}A > 阈值0.5A）",
    "temperature_jump": "温度跳变过大（上一行{previous}℃→本行{current}℃，跳变{value}℃ > 阈值3.0℃）",
}
CELL_REASON = "{channel}跳变过大（上一行{previous}V→本行{current}V，跳变{jump}V > 阈值0.05V）"
CELL_THRESHOLD = 0.05
TASK = (
    "请分析以下电池测试数据，判断是否存在异常（异常标准："
    "1.充电时：总电压跳变>3V、单体电压跳变>0.02V、电流跳变>0.5A；"
    "2.放电时：总电压>378.2V、单体电压跳变>0.02V；"
    "3.充电/放电共通：温度跳变>3℃）。"
)

# ---- end of fixed values ---------------------------------------------------

_EARLY = ["charge_total_jump", "discharge_total_limit"]
_LATE = ["charge_current_jump", "temperature_jump"]
_CHANNELS = ["total_voltage", "current", "temperature"]


def labelled_table(
    raw: DataFrame, order: Sequence[str], segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Adds ``is_anomaly`` and ``anomaly_reasons`` to a wide table.

    Every column whose name contains the cell marker counts as a cell. A state
    must equal its code exactly.
    """
    cells = channel_family(raw, cy.CELL_MARKER)
    sources = {c: cy.SOURCE_COLUMNS[c] for c in _CHANNELS}
    typed = typed_channels(raw, [*cells, *sources.values(), cy.STATE_COLUMN], finite=False)
    named = typed.withColumns(
        {
            **{c: F.col(f"`{source}`") for c, source in sources.items()},
            "state": F.col(f"`{cy.STATE_COLUMN}`"),
            "cells": F.array(*[F.col(f"`{c}`") for c in cells]),
        }
    )
    moving = [*_CHANNELS, "cells"]
    stepped = over_history(
        named,
        [],
        order,
        1,
        lambda w: {f"previous_{c}": F.lag(c).over(w) for c in moving},
        segment_rows,
    )
    rules = {r.name: r for r in cy.RULES if r.name != "cell_voltage_jump"}
    flagged = add_rule_flags(add_differences(stepped, _CHANNELS), list(rules.values()))
    if cells:
        jumps = jumps_between("previous_cells", "cells", cells, CELL_THRESHOLD)
        cell_reasons = F.transform(
            jumps,
            lambda j: render(
                CELL_REASON,
                {
                    "channel": j["channel"],
                    "previous": fixed(j["previous"], 4),
                    "current": fixed(j["value"], 4),
                    "jump": fixed(j["jump"], 4),
                },
            ),
        )
    else:
        cell_reasons = F.array().cast("array<string>")
    found = F.concat(
        reasons([rules[n] for n in _EARLY], WHOLE_REASONS, 2),
        cell_reasons,
        reasons([rules[n] for n in _LATE], WHOLE_REASONS, 2),
    )
    labelled = computed_once(flagged, {"__found": found})
    text = F.when(F.size("__found") > 0, F.array_join("__found", "; ")).otherwise(
        F.lit(cy.NO_REASON)
    )
    return labelled.select(
        *[F.col(f"`{c}`") for c in raw.columns],
        (F.size("__found") > 0).alias("is_anomaly"),
        text.alias("anomaly_reasons"),
    )


def instruction_samples(labelled: DataFrame) -> DataFrame:
    """Instruction and answer texts; rows without any value are dropped."""
    columns = [c for c in labelled.columns if c not in ("is_anomaly", "anomaly_reasons")]
    listed = computed_once(labelled, {"__values": named_values(columns, "：")})
    word = F.when(F.col("is_anomaly"), F.lit(cy.POSITIVE)).otherwise(F.lit(cy.NEGATIVE))
    return listed.filter(F.size("__values") > 0).select(
        F.concat(F.lit(TASK + "\n"), F.array_join("__values", "\n")).alias("instruction"),
        F.concat(word, F.lit("。"), F.col("anomaly_reasons")).alias("output"),
        "is_anomaly",
        "anomaly_reasons",
        *[F.col(f"`{c}`").cast("string").alias(c) for c in columns],
    )
