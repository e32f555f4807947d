"""Fit and tune on balanced rows, evaluate on several data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepguard.operators import evaluate as ea
from stepguard.operators.features import standardised
from stepguard.operators.forests import (
    feature_importance,
    fit_isolation_forest,
    fit_random_forest,
    score_isolation_forest,
    score_random_forest,
)
from stepguard.operators.sampling import balanced_sample, fan_out
from stepguard.session import checkpointed

FIT, TUNE = "train", "val"


def study_rows(rows: DataFrame, cases: DataFrame, seed: int) -> DataFrame:
    """All data sets in one table, with ``dataset`` beside (record_id, gold, features).

    ``rows`` has (record_id, split, gold, features) and should be stored; ``cases``
    are near-threshold cases with (record_id, gold, features). A record comes once
    for each data set it belongs to: balanced train, validation and test rows, all
    test rows, and the cases.
    """
    even = balanced_sample(rows, "split", "gold", "record_id", seed).select(
        F.col("record_id").alias("__even")
    )
    marked = rows.join(even, F.col("record_id") == F.col("__even"), "left")
    balanced = F.col("__even").isNotNull()
    targets = {
        FIT: balanced & (F.col("split") == "train"),
        TUNE: balanced & (F.col("split") == "val"),
        "test_balanced": balanced & (F.col("split") == "test"),
        "test_natural": F.col("split") == "test",
    }
    columns = ["dataset", "record_id", "gold", "features"]
    return checkpointed(
        fan_out(marked, targets)
        .select(*columns)
        .unionByName(cases.withColumn("dataset", F.lit("boundary")).select(*columns))
    )


def evaluated(scored: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """Prediction table and metric table of one scored method.

    ``scored`` has (dataset, record_id, gold, score). The threshold with the best
    F1 on the rows for tuning is applied to every data set.
    """
    table = checkpointed(scored.select("dataset", "record_id", "gold", "score"))
    curve = ea.score_curve(table.filter(F.col("dataset") == TUNE), [], "gold", "score")
    threshold = ea.tune_threshold(curve, []).select("threshold").scalar()
    predictions = checkpointed(
        table.withColumns({"method": F.lit(method), "threshold": threshold}).withColumn(
            "pred", F.col("score") >= F.col("threshold")
        )
    )
    by = ["method", "dataset"]
    ranking = ea.ranking_metrics(ea.score_curve(predictions, by, "gold", "score"), by)
    rates = ea.metrics(predictions, by, "gold", "pred", "mixed")
    return predictions, rates.join(ranking, by)


def isolation_forest_baseline(
    rows: DataFrame, size: int, trees: int = 300, sample_rows: int = 256, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Isolation forest grown on the normal rows for fitting; ``rows`` from :func:`study_rows`."""
    normal = (F.col("dataset") == FIT) & ~F.col("gold")
    scaled = standardised(rows, "features", size, normal, "scaled")
    nodes = fit_isolation_forest(
        scaled.filter(normal), "record_id", "scaled", trees, sample_rows, seed
    )
    return evaluated(score_isolation_forest(scaled, nodes, "scaled"), "isolation_forest")


def random_forest_baseline(
    rows: DataFrame, names: list[str], trees: int = 500, depth: int = 30, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Random forest on the rows for fitting; ``rows`` from :func:`study_rows`."""
    fit = rows.filter(F.col("dataset") == FIT)
    model = fit_random_forest(fit, "gold", "features", trees, depth, seed)
    predictions, metrics = evaluated(score_random_forest(model, rows, "features"), "random_forest")
    return predictions, metrics, feature_importance(model, rows, names)
