"""Rule verification of model verdicts, over all rows and near the thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepguard.functions.verdicts import reconcile
from stepguard.operators import evaluate as ea
from stepguard.operators import profile as pf
from stepguard.operators.rules import Rule, band_members, isolated
from stepguard.plans import cycler as cy
from stepguard.session import checkpointed

SIDES = ["below_or_equal", "above"]
SCOPES = ["all", "isolated"]


@dataclass(frozen=True)
class VerifierReport:
    rule_predictions: DataFrame
    missing: DataFrame
    comparison: DataFrame
    inconsistent: DataFrame


def verifier_report(references: DataFrame, predictions: DataFrame) -> VerifierReport:
    """Check every verdict against the rules read from the question text.

    ``references`` has (dataset, record_id, gold, text), ``predictions`` has
    (method, dataset, record_id, pred, anomaly_score).
    """
    checked = checkpointed(
        cy.verified(references, "text")
        .withColumn("matches_gold", F.col("rule_pred") == F.col("gold"))
        .drop("text")
    )
    fields = ["state", "total_voltage", *[f"{c}_diff" for c in cy.CHANNELS]]
    joined = predictions.select("method", "dataset", "record_id", "pred", "anomaly_score").join(
        checked, ["dataset", "record_id"]
    )
    final, kind = reconcile(F.col("pred"), F.col("rule_pred"))
    decided = joined.withColumns({"final_pred": final, "correction_type": kind})
    comparison = ea.overrides(
        decided, ["method", "dataset"], "gold", "pred", "rule_pred", "final_pred"
    )
    inconsistent = decided.filter(~F.col("pred").eqNullSafe(F.col("rule_pred"))).select(
        "method",
        "dataset",
        "record_id",
        "gold",
        "pred",
        "rule_pred",
        "final_pred",
        "correction_type",
        "anomaly_score",
        "rule_reason",
    )
    return VerifierReport(
        checked, pf.missing_counts(checked, fields, ["dataset"]), comparison, inconsistent
    )


@dataclass(frozen=True)
class NearThresholdReport:
    members: DataFrame
    manifest: DataFrame
    metrics: DataFrame
    sides: DataFrame
    paired: DataFrame
    overrides: DataFrame


def near_threshold_report(
    labelled: DataFrame,
    predictions: DataFrame,
    rules: Sequence[Rule],
    methods: Sequence[str],
    record_id: str = "record_id",
    window: str = "primary",
) -> NearThresholdReport:
    """Evaluate methods on the records close to each threshold.

    ``labelled`` has the rule features, triggers and label; ``predictions`` has
    (method, record_id, pred, anomaly_score). Each rule is looked at over all
    its records and over those on which no other rule fired.
    """
    near = band_members(
        labelled, rules, [record_id, "rule_triggers", F.col("is_anomaly").alias("gold")]
    ).filter(F.col("window_name") == window)
    alone = isolated(F.col("rule_triggers"), F.col("rule"))
    scopes = F.array_compact(F.array(F.lit("all"), F.when(alone, F.lit("isolated"))))
    members = checkpointed(
        near.withColumn("isolated_target_rule", alone).withColumn("scope", F.explode(scopes))
    )
    manifest = members.groupBy("rule", "scope").agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.count_if(F.col("side") == side).alias(side) for side in SIDES],
        F.count_if(~F.col("gold")).alias("gold_normal"),
        F.count_if(F.col("gold")).alias("gold_anomaly"),
        F.count_if(~F.col("isolated_target_rule")).alias("records_with_other_rule_triggers"),
    )
    scored = checkpointed(
        predictions.select("method", record_id, "pred", "anomaly_score").join(members, record_id)
    )
    by = ["method", "rule", "scope"]
    rates = ea.metrics(scored, by, "gold", "pred", "mixed")
    rates = ea.with_exact_interval(rates, F.col("tp") + F.col("tn"), F.col("samples"))
    curve = ea.score_curve(scored, by, "gold", "anomaly_score")
    axes = {
        "method": list(methods),
        "rule": [r.name for r in rules],
        "scope": SCOPES,
        "side": SIDES,
    }
    sides = ea.dense_accuracy_table(scored, axes, "gold", "pred")
    patterns = ea.verdict_patterns(
        scored, ["rule", "scope"], record_id, "method", "gold", "pred", methods
    )
    tests = ea.add_mcnemar(ea.paired_counts(patterns, ["rule", "scope"], methods))
    paired = ea.holm(tests, ["rule", "scope"], "exact_two_sided_p", ["first", "second"])
    overridden = ea.overrides(
        scored.withColumn("rule_pred", F.size("rule_triggers") > 0),
        by,
        "gold",
        "pred",
        "rule_pred",
        "rule_pred",
    )
    return NearThresholdReport(
        members, manifest, rates.join(ea.ranking_metrics(curve, by), by), sides, paired, overridden
    )
