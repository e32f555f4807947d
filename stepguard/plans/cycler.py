"""Battery-cycler records: rules, texts, prompt layout and boundary suites.

The thresholds, state codes, source column names, texts and case lists below
are fixed values: results only agree with published ones when they are the same.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepguard.functions.numbers import group_key, state_code, typed_channels
from stepguard.functions.text import (
    SIGNED_INTEGER,
    chat_messages,
    first_labelled,
    fixed,
    identity_key,
    insert_turns,
    keep_lines,
    labelled_number,
    masked,
    render,
)
from stepguard.operators.adjacent import add_differences, add_steps
from stepguard.operators.boundary import CaseFamily, case_grid
from stepguard.operators.features import assemble, feature_columns
from stepguard.operators.rules import Rule, add_labels, reason_text, reasons
from stepguard.operators.sampling import lowest_per_label, replicated
from stepguard.operators.stage import computed_once, read_once

# ---- fixed values ----------------------------------------------------------

CHARGE = 110
DISCHARGE = 30
REST = 0
STATE_NAMES = {CHARGE: "charge", DISCHARGE: "discharge"}
OTHER_STATE = "other_or_idle"
STATE_BUCKETS = ["charge", "discharge", "other_or_idle"]
STEP_STATUS = {REST: "静置", CHARGE: "充电", DISCHARGE: "放电"}

STATE_COLUMN = "整车State状态（状态机编码）"
SOURCE_COLUMNS = {
    "total_voltage": "动力电池内部总电压V1",
    "cell_voltage": "1号电池单体电压",
    "current": "动力电池充/放电电流",
    "temperature": "1号温度检测点温度",
}
CELL_MARKER = "号电池单体电压"
CHANNELS = ["total_voltage", "cell_voltage", "current", "temperature"]
UNITS = {"total_voltage": "V", "cell_voltage": "V", "current": "A", "temperature": "℃"}
SHORT_NAMES = {
    "total_voltage": "总电压",
    "cell_voltage": "单体电压",
    "current": "电流",
    "temperature": "温度",
}

RULES = [
    Rule(
        "charge_total_jump", "total_voltage", "jump", 3.0, (CHARGE,),
        {"tight": 0.001, "primary": 0.01, "broad": 0.1}, "V",
    ),
    Rule(
        "charge_current_jump", "current", "jump", 0.5, (CHARGE,),
        {"tight": 0.001, "primary": 0.01, "broad": 0.05}, "A",
    ),
    Rule(
        "cell_voltage_jump", "cell_voltage", "jump", 0.05, None,
        {"tight": 0.0001, "primary": 0.001, "broad": 0.005}, "V",
    ),
    Rule(
        "temperature_jump", "temperature", "jump", 3.0, None,
        {"tight": 0.001, "primary": 0.01, "broad": 0.1}, "degC",
    ),
    Rule(
        "discharge_total_limit", "total_voltage", "level", 378.2, (DISCHARGE,),
        {"tight": 0.001, "primary": 0.01, "broad": 0.1}, "V",
    ),
]
RULE_NAMES = [rule.name for rule in RULES]

REMOVALS = {
    "original_all_rules": [],
    "remove_charge_total_jump": ["charge_total_jump"],
    "remove_cell_voltage_jump": ["cell_voltage_jump"],
    "remove_discharge_total_limit": ["discharge_total_limit"],
    "remove_both_total_voltage_rules": ["charge_total_jump", "discharge_total_limit"],
}

MISSING = "缺失"
POSITIVE = "异常"
NEGATIVE = "正常"
NO_REASON = "无异常"

DATASET_REASONS = {
    "charge_total_jump": "充电时总电压跳变{value}V > 3.0V",
    "charge_current_jump": "充电时电流跳变{value}A > 0.5A",
    "cell_voltage_jump": "单体电压跳变{value}V > 0.05V",
    "temperature_jump": "温度跳变{value}℃ > 3.0℃",
    "discharge_total_limit": "放电时总电压{value}V > 378.2V",
}
VERIFIER_REASONS = {
    "charge_total_jump": "充电总电压跳变异常：{value}V > 3.0V",
    "charge_current_jump": "充电电流跳变异常：{value}A > 0.5A",
    "cell_voltage_jump": "单体电压跳变异常：{value}V > 0.05V",
    "temperature_jump": "温度跳变异常：{value}℃ > 3.0℃",
    "discharge_total_limit": "放电总电压超限：{value}V > 378.2V",
}
BOUNDARY_REASONS = {
    "charge_total_jump": "充电总电压跳变过大（跳变{value}V > 阈值3.0V）",
    "charge_current_jump": "充电时电流跳变过大（跳变{value}A > 阈值0.5A）",
    "cell_voltage_jump": "1号电池单体电压跳变过大（跳变{value}V > 阈值0.05V）",
    "temperature_jump": "温度跳变过大（跳变{value}℃ > 阈值3.0℃）",
    "discharge_total_limit": "放电总电压超限（当前总电压{value}V > 阈值378.2V）",
}

PROMPT_HEAD = """请根据下面的锂电池测试数据判断是否异常，并给出原因。

异常规则：
1. 充电状态下，总电压相邻跳变 > 3V 判为异常；
2. 充电状态下，电流相邻跳变 > 0.5A 判为异常；
3. {scope}单体电压相邻跳变 > 0.05V 判为异常；
4. {scope}温度相邻跳变 > 3℃ 判为异常；
5. 放电状态下，总电压 > 378.2V 判为异常。

当前样本：
"""
PROMPT_TAIL = "请只按照规则输出“正常”或“异常”，并说明触发或未触发的原因。"
PROMPT_CHANNEL = """当前{name}：{value} {unit}
{before}{name}：{previous} {unit}
{name}相邻跳变：{jump} {unit}

"""
NATURAL_SCOPE = "所有运行状态下，"
NATURAL_BEFORE = "本循环上一行"
BOUNDARY_BEFORE = "上一行"
NATURAL_FIELDS = """记录号：{record_id}
循环号：{cycle_no}
时间：{ts}
工步状态：{step_status}
状态编码：{state_text}

"""
BOUNDARY_FIELDS = """记录号：{record_id}
{case_label}：{case_type}
时间：{suite}
工步状态：{step_status}
状态编码：{state_text}

"""
NATURAL_SYSTEM = "你是电池测试数据异常检测专家，必须严格按照给定阈值、运行状态和本循环相邻跳变特征判断异常。"
BOUNDARY_SYSTEM = "你是一个锂电池异常检测专家，需要严格按照给定规则判断样本是否异常。"
DEMO_HEAD = "按照系统给出的五条电池异常规则判断以下训练示例，只回答正常或异常。\n"
DEMO_PREFIXES = [
    "状态编码：",
    "当前总电压：",
    "本循环上一行总电压：",
    "总电压相邻跳变：",
    "当前单体电压：",
    "本循环上一行单体电压：",
    "单体电压相邻跳变：",
    "当前电流：",
    "本循环上一行电流：",
    "电流相邻跳变：",
    "当前温度：",
    "本循环上一行温度：",
    "温度相邻跳变：",
]

STATE_LABELS = ["状态编码", "整车State状态（状态机编码）", "State状态"]
TEXT_LABELS = {
    "total_voltage": {
        "previous": ["上一行总电压", "上一行动力电池内部总电压V1", "上一时刻总电压"],
        "current": [
            "当前总电压", "本行总电压", "当前动力电池内部总电压V1", "本行动力电池内部总电压V1",
        ],
        "jump": [
            "总电压相邻跳变", "总电压跳变", "动力电池内部总电压V1相邻跳变", "动力电池内部总电压V1跳变",
        ],
    },
    "cell_voltage": {
        "previous": [
            "上一行1号电池单体电压", "上一行单体电压", "上一时刻1号电池单体电压", "上一时刻单体电压",
        ],
        "current": ["当前1号电池单体电压", "本行1号电池单体电压", "当前单体电压", "本行单体电压"],
        "jump": [
            "1号电池单体电压相邻跳变", "1号电池单体电压跳变", "单体电压相邻跳变", "单体电压跳变",
        ],
    },
    "current": {
        "previous": ["上一行电流", "上一行动力电池充/放电电流", "上一时刻电流"],
        "current": ["当前电流", "本行电流", "当前动力电池充/放电电流", "本行动力电池充/放电电流"],
        "jump": [
            "电流相邻跳变", "电流跳变", "动力电池充/放电电流相邻跳变", "动力电池充/放电电流跳变",
        ],
    },
    "temperature": {
        "previous": ["上一行温度", "上一行1号温度检测点温度", "上一时刻温度"],
        "current": ["当前温度", "本行温度", "当前1号温度检测点温度", "本行1号温度检测点温度"],
        "jump": ["温度相邻跳变", "温度跳变", "1号温度检测点温度相邻跳变", "1号温度检测点温度跳变"],
    },
}

ID_MASK = (r"记录号：\d+", "记录号：<ID>")
CASE_MASK = (r"(边界训练样本类型|边界样本类型)：[^\n]+", "")
TIME_MASK = (r"时间：boundary_(train|test)", "时间：<BOUNDARY>")

TEST_FIRST_ID = 900_000
TRAIN_FIRST_ID = 910_000
TRAIN_COPIES = 3

_QUIET = {"total_voltage": 3.8, "cell_voltage": 3.8, "current": 0.0, "temperature": 25.0}
_LOADED = {**_QUIET, "current": 10.0}

TEST_FAMILIES = [
    CaseFamily(
        "charge_current_boundary", "current", "jump", (CHARGE,), (10.0,),
        (0.49, 0.499, 0.50, 0.501, 0.51, 0.07), _QUIET,
    ),
    CaseFamily(
        "non_charge_current_applicability", "current", "jump", (REST, DISCHARGE), (10.0,),
        (0.501, 0.51, 1.00, 44.48), _QUIET,
    ),
    CaseFamily(
        "cell_voltage_boundary", "cell_voltage", "jump", (REST, CHARGE, DISCHARGE), (3.8,),
        (0.0308, 0.0343, 0.049, 0.0499, 0.0500, 0.0501, 0.0510, 0.0588), _QUIET,
        ("total_voltage",),
    ),
    CaseFamily(
        "temperature_boundary", "temperature", "jump", (REST, CHARGE, DISCHARGE), (25.0,),
        (2.99, 2.999, 3.000, 3.001, 3.01), _QUIET,
    ),
    CaseFamily(
        "charge_total_voltage_jump_boundary", "total_voltage", "jump", (CHARGE,), (300.0,),
        (2.99, 2.999, 3.000, 3.001, 3.01), _LOADED,
    ),
    CaseFamily(
        "non_charge_total_voltage_jump_applicability", "total_voltage", "jump",
        (REST, DISCHARGE), (300.0,), (3.001, 3.01), _QUIET,
    ),
    CaseFamily(
        "discharge_total_voltage_limit_boundary", "total_voltage", "level", (DISCHARGE,), (0.0,),
        (378.19, 378.199, 378.200, 378.201, 378.210), _QUIET,
    ),
    CaseFamily(
        "non_discharge_total_voltage_limit_applicability", "total_voltage", "level",
        (REST, CHARGE), (0.0,), (378.201, 378.210), _QUIET,
    ),
]

TRAIN_FAMILIES = [
    CaseFamily(
        "train_charge_current_boundary", "current", "jump", (CHARGE,), (2.0, 10.0, 30.0, 44.0),
        (0.08, 0.20, 0.35, 0.48, 0.4955, 0.5005, 0.5055, 0.52, 0.60, 1.20, 10.0, 40.0), _QUIET,
    ),
    CaseFamily(
        "train_non_charge_current_applicability", "current", "jump", (REST, DISCHARGE),
        (0.0, 10.0, 30.0), (0.5005, 0.5055, 0.52, 1.2, 10.0, 40.0), _QUIET,
    ),
    CaseFamily(
        "train_cell_voltage_boundary", "cell_voltage", "jump", (REST, CHARGE, DISCHARGE),
        (2.8, 3.0, 3.8, 4.15),
        (0.020, 0.032, 0.040, 0.0485, 0.0495, 0.0505, 0.0520, 0.0560, 0.0700, 0.1200), _QUIET,
        ("total_voltage",),
    ),
    CaseFamily(
        "train_temperature_boundary", "temperature", "jump", (REST, CHARGE, DISCHARGE),
        (15.0, 25.0, 35.0), (1.0, 2.5, 2.90, 2.95, 2.9955, 3.0055, 3.02, 3.20, 5.0), _QUIET,
    ),
    CaseFamily(
        "train_charge_total_voltage_jump_boundary", "total_voltage", "jump", (CHARGE,),
        (3.8, 100.0, 300.0), (1.0, 2.5, 2.95, 2.9955, 3.0055, 3.02, 3.20, 5.0), _LOADED,
    ),
    CaseFamily(
        "train_non_charge_total_voltage_jump_applicability", "total_voltage", "jump",
        (REST, DISCHARGE), (3.8, 300.0), (3.0055, 3.02, 3.20, 5.0), _QUIET,
    ),
    CaseFamily(
        "train_discharge_total_voltage_limit_boundary", "total_voltage", "level", (DISCHARGE,),
        (0.0,), (378.18, 378.195, 378.205, 378.22, 379.0, 400.0), _QUIET,
    ),
    CaseFamily(
        "train_non_discharge_total_voltage_limit_applicability", "total_voltage", "level",
        (REST, CHARGE), (0.0,), (378.205, 378.22, 379.0, 400.0), _QUIET,
    ),
]

# ---- end of fixed values ---------------------------------------------------


def records(raw: DataFrame) -> DataFrame:
    """Raw records (numbers kept as text) to typed measurement records."""
    renamed = raw.withColumnsRenamed({v: k for k, v in SOURCE_COLUMNS.items()})
    typed = typed_channels(renamed, CHANNELS)
    return typed.withColumns(
        {
            "cycle_no": group_key(F.col("cycle_no")),
            "state": state_code(F.col(f"`{STATE_COLUMN}`")),
            "state_text": F.coalesce(F.col(f"`{STATE_COLUMN}`").cast("string"), F.lit("None")),
        }
    ).drop(STATE_COLUMN)


def labelled(typed: DataFrame, order: Sequence[str] = ("record_id",), **options) -> DataFrame:
    """Previous values, differences, rule flags, label and triggers, reset per cycle."""
    stepped = add_steps(typed, ["cycle_no"], order, CHANNELS, **options)
    return add_labels(stepped, RULES)


def prompt(natural: bool, case_label: str = "", suite: str = "") -> Column:
    """The question text of a labelled row."""
    before = NATURAL_BEFORE if natural else BOUNDARY_BEFORE
    fields: dict[str, Column] = {
        "record_id": F.col("record_id"),
        "step_status": F.coalesce(F.col("step_status"), F.lit("None")),
        "state_text": F.col("state_text"),
    }
    template = PROMPT_HEAD.replace("{scope}", NATURAL_SCOPE if natural else "")
    if natural:
        template += NATURAL_FIELDS
        fields |= {"cycle_no": F.col("cycle_no"), "ts": F.coalesce(F.col("ts"), F.lit("None"))}
    else:
        template += BOUNDARY_FIELDS.replace("{case_label}", case_label).replace("{suite}", suite)
        fields["case_type"] = F.col("case_type")
    for name in CHANNELS:
        template += (
            PROMPT_CHANNEL.replace("{name}", SHORT_NAMES[name])
            .replace("{unit}", UNITS[name])
            .replace("{before}", before)
            .replace("{value}", f"{{{name}}}")
            .replace("{previous}", f"{{previous_{name}}}")
            .replace("{jump}", f"{{{name}_diff}}")
        )
        for column in (name, f"previous_{name}", f"{name}_diff"):
            fields[column] = fixed(F.col(column), 4, MISSING)
    return render(template + PROMPT_TAIL, fields)


def answer(templates: dict[str, str], separator: str) -> Column:
    found = reasons(RULES, templates, 4)
    text = reason_text(found, separator, NO_REASON)
    return F.concat(F.when(F.size(found) > 0, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE)), F.lit("。"), text)


def natural_samples(rows: DataFrame) -> DataFrame:
    """Labelled records with their chat messages."""
    messages = chat_messages(F.lit(NATURAL_SYSTEM), prompt(True), answer(DATASET_REASONS, "; "))
    return computed_once(rows, {"messages": messages})


def suite_cases(
    spark: SparkSession, families: Sequence[CaseFamily], first_id: int
) -> DataFrame:
    """Grid cases with differences and labels."""
    grid = case_grid(spark, families, CHANNELS, first_id)
    status = F.lit(None).cast("string")
    for code, name in STEP_STATUS.items():
        status = F.when(F.col("state") == code, F.lit(name)).otherwise(status)
    stepped = add_differences(grid, CHANNELS)
    named = stepped.withColumns({"step_status": status, "state_text": F.col("state").cast("string")})
    once = computed_once(named, {name: F.col(name) for name in named.columns})
    return add_labels(once, RULES).withColumn("gold", F.col("is_anomaly"))


def boundary_tests(spark: SparkSession) -> DataFrame:
    cases = suite_cases(spark, TEST_FAMILIES, TEST_FIRST_ID)
    messages = chat_messages(
        F.lit(BOUNDARY_SYSTEM),
        prompt(False, "边界样本类型", "boundary_test"),
        answer(BOUNDARY_REASONS, "；"),
    )
    return computed_once(cases, {"messages": messages})


def boundary_training(spark: SparkSession, copies: int = TRAIN_COPIES) -> DataFrame:
    """Training scenarios, each ``copies`` times under fresh ids."""
    cases = suite_cases(spark, TRAIN_FAMILIES, TRAIN_FIRST_ID)
    distinct = sum(f.size for f in TRAIN_FAMILIES)
    texts = cases.select(
        "record_id",
        "case_type",
        "gold",
        prompt(False, "边界训练样本类型", "boundary_train").alias("prompt"),
        answer(BOUNDARY_REASONS, "；").alias("answer"),
    )

    def fresh(record_id: Column, copy: Column) -> Column:
        place = record_id - TRAIN_FIRST_ID
        return F.lit(TRAIN_FIRST_ID + distinct) + place * (copies - 1) + copy - 1

    spread = replicated(texts, "record_id", copies, fresh, "prompt", "记录号：")
    return spread.select(
        "record_id",
        "case_type",
        "gold",
        chat_messages(F.lit(BOUNDARY_SYSTEM), F.col("prompt"), F.col("answer")).alias("messages"),
    )


def scenario_key(messages: Column, case_type: Column) -> Column:
    """Identity of a scenario: case type, question without its id, and answer."""
    question = masked(F.element_at(messages, 2)["content"], [ID_MASK])
    return identity_key(case_type, question, F.element_at(messages, -1)["content"])


def question_signature(messages: Column) -> Column:
    """The question without id, case type and suite name."""
    return masked(F.element_at(messages, 2)["content"], [ID_MASK, CASE_MASK, TIME_MASK])


def parsed_fields(text: Column, strict_labels: bool = False) -> dict[str, Column]:
    """What the rules need from a question text: state, jumps, and values of level rules.

    A jump that is not written down is recomputed from the two values.
    ``strict_labels`` reads only the standard labels and takes the jumps as
    written.
    """
    wanted = 1 if strict_labels else None
    levels = {rule.channel for rule in RULES if rule.kind == "level"}
    fields = {"state": first_labelled(text, STATE_LABELS[:wanted], SIGNED_INTEGER, "int")}
    for name in CHANNELS:
        labels = TEXT_LABELS[name]
        if strict_labels:
            now = first_labelled(text, [f"当前{SHORT_NAMES[name]}"])
            jump = first_labelled(text, [f"{SHORT_NAMES[name]}相邻跳变"])
        else:
            now = first_labelled(text, labels["current"])
            before = first_labelled(text, labels["previous"])
            jump = F.coalesce(first_labelled(text, labels["jump"]), F.abs(now - before))
        if name in levels:
            fields[name] = now
        fields[f"{name}_diff"] = jump
    return fields


def verified(df: DataFrame, text: str, digits: int = 6, strict_labels: bool = False) -> DataFrame:
    """Re-check records from their question text.

    Adds the parsed fields, the rule flags, ``rule_pred`` and ``rule_reason``.
    """
    once = computed_once(df, {text: F.col(text)})
    parsed = read_once(once, text, lambda value: parsed_fields(value, strict_labels))
    flagged = add_labels(parsed, RULES)
    found = reasons(RULES, VERIFIER_REASONS, digits)
    return flagged.withColumnsRenamed({"is_anomaly": "rule_pred"}).withColumn(
        "rule_reason", reason_text(found, "；", NO_REASON)
    )


def prompt_values(text: Column, before: str = BOUNDARY_BEFORE) -> dict[str, Column]:
    """Current and previous channel values of a standard question; the missing marker is null."""
    fields = {}
    for name in CHANNELS:
        label, unit = SHORT_NAMES[name], UNITS[name]
        fields[name] = labelled_number(text, f"当前{label}", unit, MISSING)
        fields[f"previous_{name}"] = labelled_number(text, f"{before}{label}", unit, MISSING)
    return fields


def answer_label(messages: Column) -> Column:
    """Label of a sample, read from the start of its answer."""
    return F.element_at(messages, -1)["content"].startswith(POSITIVE)


def demonstrations(samples: DataFrame, per_label: int = 2, seed: int = 42) -> DataFrame:
    """Training samples used as worked examples: the lowest seeded keys of each label."""
    chosen = lowest_per_label(
        samples.select("record_id", "cycle_no", "is_anomaly", "messages"),
        "is_anomaly",
        "record_id",
        per_label,
        seed,
    )
    question = F.element_at("messages", 2)["content"]
    return chosen.select(
        "record_id",
        "cycle_no",
        "is_anomaly",
        "selection_key",
        F.concat(F.lit(DEMO_HEAD), keep_lines(question, DEMO_PREFIXES)).alias("user"),
        F.when(F.col("is_anomaly"), F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE)).alias("assistant"),
    )


def few_shot_messages(
    samples: DataFrame, examples: DataFrame, per_label: int = 2, seed: int = 42
) -> DataFrame:
    """Messages without their answer, with the examples put before the question.

    The examples are ``2 * per_label`` rows and are read as one scalar. Their
    order is a seeded shuffle of (label, key) order.
    """
    places = list(range(2 * per_label))
    random.Random(seed).shuffle(places)
    ordered = F.sort_array(
        F.collect_list(F.struct("is_anomaly", "selection_key", "user", "assistant"))
    )
    turns = F.flatten(
        F.transform(
            F.array(*[F.element_at("all", place + 1) for place in places]),
            lambda e: F.array(
                F.struct(F.lit("user").alias("role"), e["user"].alias("content")),
                F.struct(F.lit("assistant").alias("role"), e["assistant"].alias("content")),
            ),
        )
    )
    scalar = examples.agg(ordered.alias("all")).select(turns).scalar()
    return samples.withColumn("messages", insert_turns(F.col("messages"), scalar))


def boundary_features(cases: DataFrame) -> DataFrame:
    """Feature vectors of suite cases, from their question texts.

    The texts show four decimals, so the stored differences replace the ones
    that could be computed from them: rounding may flip a strict comparison.
    """
    stored = {f"stored_{c}": F.col(f"{c}_diff") for c in CHANNELS}
    texts = cases.select(
        "record_id",
        "case_type",
        "gold",
        "state",
        *[column.alias(name) for name, column in stored.items()],
        F.element_at("messages", 2)["content"].alias("text"),
    )
    parsed = read_once(computed_once(texts, {"text": F.col("text")}), "text", prompt_values)
    differences = {
        f"{c}_diff": F.coalesce(F.col(f"stored_{c}"), F.abs(F.col(c) - F.col(f"previous_{c}")))
        for c in CHANNELS
    }
    rows = parsed.withColumns(differences).drop("text", *stored)
    return assemble(rows, feature_columns(CHANNELS, [CHARGE, DISCHARGE]))
