"""Evaluation of verdicts and scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.functions.numbers import rate
from stepguard.functions.stats import exact_interval, mcnemar_p
from stepguard.operators.ordered import SEGMENT_ROWS, running_totals
from stepguard.operators.profile import zero_grid
from stepguard.session import checkpointed

COUNTS = ["samples", "tp", "fp", "tn", "fn"]


def confusion(df: DataFrame, by: Sequence[str], gold: str, pred: str) -> DataFrame:
    """The four cells per group. Rows without a verdict are counted apart."""
    g, p = F.col(gold), F.col(pred)
    return df.groupBy(*by).agg(
        F.count(p).alias("samples"),
        F.count_if(g & p).alias("tp"),
        F.count_if(~g & p).alias("fp"),
        F.count_if(~g & ~p).alias("tn"),
        F.count_if(g & ~p).alias("fn"),
        F.count_if(p.isNull()).alias("unparsed"),
    )


def add_rates(cells: DataFrame, empty: str = "null") -> DataFrame:
    """Rates from the four cells.

    ``empty`` says what a rate over nothing is: ``null``; ``zero``; or
    ``mixed``, where precision, recall and F1 are zero and the others null.
    """
    scores = None if empty == "null" else 0.0
    others = 0.0 if empty == "zero" else None
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = rate(tp, tp + fp, scores), rate(tp, tp + fn, scores)
    # A true positive is needed for F1 to be defined as 2PR/(P+R).
    f1 = F.when(tp > 0, 2 * precision * recall / (precision + recall))
    if scores is not None:
        f1 = F.coalesce(f1, F.lit(0.0))
    return cells.withColumns(
        {
            "prevalence": rate(tp + fn, F.col("samples"), others),
            "accuracy": rate(tp + tn, F.col("samples"), others),
            "precision": precision,
            "recall": recall,
            "f1": f1,
            "fpr": rate(fp, fp + tn, others),
            "fnr": rate(fn, fn + tp, others),
            "specificity": rate(tn, tn + fp, others),
        }
    )


def metrics(
    df: DataFrame, by: Sequence[str], gold: str, pred: str, empty: str = "null"
) -> DataFrame:
    return add_rates(confusion(df, by, gold, pred), empty)


def score_curve(
    df: DataFrame,
    by: Sequence[str],
    gold: str,
    score: str,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Cumulative hits from the highest score down, one row per distinct score.

    Equal scores are merged before anything is ordered. The merged points are
    stored, since the row count and the ordered pass both read them. A score that
    is null, NaN or infinite has no place in the order and stops the job.
    """
    value = F.col(score).cast("double")
    refused = F.raise_error(F.lit("a score is null or not finite")).cast("double")
    unusable = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    points = checkpointed(
        df.groupBy(*by, F.when(unusable, refused).otherwise(F.col(score)).alias("threshold"))
        .agg(
            F.count_if(F.col(gold)).alias("pos"),
            F.count_if(~F.col(gold)).alias("neg"),
        )
        .withColumn("__down", -F.col("threshold"))
    )
    return running_totals(
        points,
        by,
        ["__down"],
        {"cum_tp": F.col("pos"), "cum_fp": F.col("neg")},
        {"positives": F.col("pos"), "negatives": F.col("neg")},
        segment_rows,
    ).drop("__down")


def ranking_metrics(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUROC with tied scores and average precision; null with one class only."""
    above = F.col("cum_fp") - F.col("neg") * 0.5
    lost = F.sum(F.col("pos") * above)
    gained = F.sum(F.col("pos") * (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))))
    summed = curve.groupBy(*by).agg(
        F.sum("pos").alias("__p"),
        F.sum("neg").alias("__n"),
        lost.alias("__lost"),
        gained.alias("__gained"),
    )
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    # The product of the class sizes can pass the bigint range, so it is taken in double.
    pairs = F.col("__p").cast("double") * F.col("__n")
    return summed.select(
        *by,
        F.when(both, 1.0 - F.try_divide(F.col("__lost"), pairs)).alias("auroc"),
        F.when(both, F.try_divide(F.col("__gained"), F.col("__p"))).alias("auprc"),
    )


def precision_recall_points(curve: DataFrame) -> DataFrame:
    """Precision, recall and F1 at every threshold of a curve."""
    tp, shown = F.col("cum_tp").cast("double"), F.col("cum_tp") + F.col("cum_fp")
    precision = tp / shown
    recall = rate(tp, F.col("positives"))
    f1 = F.when(tp > 0, 2.0 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return curve.withColumns({"precision": precision, "recall": recall, "f1": f1})


def tune_threshold(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """The threshold with the largest F1; the highest one wins a tie."""
    points = precision_recall_points(curve)
    best = F.max_by(
        F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", "threshold")
    )
    return points.groupBy(*by).agg(best.alias("__best")).select(*by, "__best.*")


def with_exact_interval(
    df: DataFrame, correct: Column, total: Column, alpha: float = 0.05
) -> DataFrame:
    return (
        df.withColumn("__ci", exact_interval(correct, total, alpha))
        .withColumns(
            {
                "accuracy_exact_ci_lower": F.col("__ci.lower"),
                "accuracy_exact_ci_upper": F.col("__ci.upper"),
            }
        )
        .drop("__ci")
    )


def accuracy_table(df: DataFrame, by: Sequence[str], gold: str, pred: str) -> DataFrame:
    """Right and wrong verdicts per group."""
    right = F.col(pred) == F.col(gold)
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(right).alias("correct")
    )
    return counted.withColumns(
        {
            "errors": F.col("samples") - F.col("correct"),
            "accuracy": rate(F.col("correct"), F.col("samples")),
        }
    )


def dense_accuracy_table(
    df: DataFrame, axes: dict[str, Sequence[str]], gold: str, pred: str
) -> DataFrame:
    """Accuracy with exact bounds for every cell of a grid; empty cells keep nulls."""
    right = F.col(pred) == F.col(gold)
    counted = df.groupBy(*axes).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(right).alias("correct")
    )
    zeros = zero_grid(df, axes, ["samples", "correct"])
    dense = counted.unionByName(zeros).groupBy(*axes).agg(
        F.sum("samples").alias("samples"), F.sum("correct").alias("correct")
    )
    dense = dense.withColumn("accuracy", rate(F.col("correct"), F.col("samples")))
    return with_exact_interval(dense, F.col("correct"), F.col("samples"))


def verdict_patterns(
    df: DataFrame,
    by: Sequence[str],
    record_id: str,
    method: str,
    gold: str,
    pred: str,
    methods: Sequence[str],
) -> DataFrame:
    """How many records share each combination of right and wrong methods.

    A record has one row per method, so the shuffle by record is even, and the
    result has at most ``2 ** len(methods)`` rows per group whatever the data.
    """
    right = F.col(pred) == F.col(gold)
    wide = df.groupBy(*by, record_id).agg(
        *[F.bool_or(F.when(F.col(method) == m, right)).alias(f"ok_{i}") for i, m in enumerate(methods)]
    )
    oks = [f"ok_{i}" for i in range(len(methods))]
    return wide.groupBy(*by, *oks).agg(F.count(F.lit(1)).alias("records"))


def paired_counts(
    patterns: DataFrame,
    by: Sequence[str],
    methods: Sequence[str],
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Agreement of every method pair, from the pattern counts.

    Pairs are formed over the patterns and never over records.
    """
    place = {m: i for i, m in enumerate(methods)}
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("first"),
                F.lit(b).alias("second"),
                F.col(f"ok_{place[a]}").alias("a"),
                F.col(f"ok_{place[b]}").alias("b"),
            )
            for a, b in (pairs or combinations(methods, 2))
        ]
    )
    long = patterns.select(*by, "records", F.inline(entries))
    a, b = F.col("a"), F.col("b")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("records"))), F.lit(0))

    return long.groupBy(*by, "first", "second").agg(
        total(a & ~b).alias("first_correct_second_wrong"),
        total(~a & b).alias("first_wrong_second_correct"),
        total(a & b).alias("both_right"),
        total(~a & ~b).alias("both_wrong"),
    )


def add_mcnemar(pairs: DataFrame) -> DataFrame:
    first, second = F.col("first_correct_second_wrong"), F.col("first_wrong_second_correct")
    return pairs.withColumns(
        {"discordant": first + second, "exact_two_sided_p": mcnemar_p(first, second)}
    )


def holm(
    tests: DataFrame, family: Sequence[str], p: str, tie_break: Sequence[str]
) -> DataFrame:
    """Step-down adjustment inside each family of tests.

    The input has one row per test, so the windows see a handful of rows.
    """
    in_order = Window.partitionBy(*family).orderBy(p, *tie_break)
    ranked = tests.withColumns(
        {
            "holm_rank": F.row_number().over(in_order),
            "__tests": F.count(F.lit(1)).over(Window.partitionBy(*family)),
        }
    )
    raw = F.least(F.lit(1.0), (F.col("__tests") - F.col("holm_rank") + 1) * F.col(p))
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranked.withColumn("__raw", raw)
        .withColumn("holm_adjusted_p", F.max("__raw").over(upto))
        .drop("__raw", "__tests")
    )


def overrides(
    df: DataFrame, by: Sequence[str], gold: str, model: str, rule: str, final: str
) -> DataFrame:
    """What replacing model verdicts by rule verdicts changes."""
    g, m, r, f = (F.col(c) for c in (gold, model, rule, final))
    differs = ~m.eqNullSafe(r)
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(g).alias("positives"),
        F.count_if(m == g).alias("model_correct"),
        F.count_if(~g & m).alias("model_fp"),
        F.count_if(g & ~m).alias("model_fn"),
        F.count_if(differs).alias("inconsistencies"),
        F.count_if(differs & ~m.eqNullSafe(g)).alias("corrected_model_errors"),
        F.count_if(differs & (m == g)).alias("unnecessary_overrides"),
        F.count_if(g & f).alias("final_tp"),
        F.count_if(~g & f).alias("final_fp"),
        F.count_if(~g & ~f).alias("final_tn"),
        F.count_if(g & ~f).alias("final_fn"),
    )
    return counted.withColumns(
        {
            "prevalence": rate(F.col("positives"), F.col("samples")),
            "model_accuracy": rate(F.col("model_correct"), F.col("samples")),
            "final_accuracy": rate(F.col("final_tp") + F.col("final_tn"), F.col("samples")),
        }
    ).drop("positives", "model_correct")


def rescored(
    predictions: DataFrame,
    labels: DataFrame,
    record_id: str,
    by: Sequence[str],
    pred: str,
    empty: str = "null",
) -> DataFrame:
    """Fixed verdicts against every label variant (long form)."""
    joined = predictions.select(*by, record_id, pred).join(labels, record_id)
    scored = metrics(joined, [*by, "variant"], "variant_label", pred, empty)
    return scored.withColumn("positive", F.col("tp") + F.col("fn"))


def wide_comparison(
    table: DataFrame, row: str, column: str, values: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """One row per method with the metrics of every dataset as columns."""
    return table.groupBy(row).pivot(column, list(values)).agg(
        *[F.first(field, ignorenulls=True).alias(field) for field in fields]
    )


def case_table(
    predictions: DataFrame,
    record_id: str,
    keep: Sequence[str],
    method: str,
    methods: Sequence[str],
    fields: Sequence[str],
) -> DataFrame:
    """Verdicts and scores of every method side by side, one row per record."""
    return predictions.groupBy(record_id, *keep).pivot(method, list(methods)).agg(
        *[F.first(field, ignorenulls=True).alias(field) for field in fields]
    )
