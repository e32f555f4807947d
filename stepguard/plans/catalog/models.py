"""Features and forests on the labelled events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepguard.operators.features import assemble, feature_columns, feature_names, standardised
from stepguard.plans import events as ev
from stepguard.plans.baselines import (
    isolation_forest_baseline,
    random_forest_baseline,
    study_rows,
)
from stepguard.plans.catalog.datasets import _CASES, SEED, near_cases
from stepguard.plans.catalog.registry import LAB, query
from stepguard.session import checkpointed

FEATURES = feature_names(ev.CHANNELS, ev.STATES)


def feature_rows(spark, folder) -> DataFrame:
    return assemble(
        ev.labelled_events(spark, folder), feature_columns(ev.CHANNELS, ev.STATES)
    )


_FEATURES = LAB + """, ft AS (SELECT event_id, split, is_anomaly, [
        (state = 'purchase')::INT::DOUBLE, (state = 'error')::INT::DOUBLE,
        (state NOT IN ('purchase', 'error'))::INT::DOUBLE,
        coalesce(value, 0), coalesce(previous_value, value, 0), coalesce(value_diff, 0),
        coalesce(k, 0), coalesce(previous_k, k, 0), coalesce(k_diff, 0),
        (previous_value IS NOT NULL AND previous_k IS NOT NULL)::INT::DOUBLE] AS x FROM lab)
"""


@query(
    "i01_feature_vector",
    _FEATURES + """SELECT event_id, len(x) AS size, round(list_sum(list_transform(x, lambda v, i: v * i)), 4)
      AS weighted FROM ft""",
)
def i01(spark, folder):
    weighted = F.aggregate(
        F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b
    )
    return feature_rows(spark, folder).select(
        "event_id",
        F.size("features").cast("bigint").alias("size"),
        F.round(weighted, 4).alias("weighted"),
    )


@query(
    "i02_standardised_on_normal_rows",
    _FEATURES + """, lg AS (SELECT event_id, split, is_anomaly, unnest(x) AS v, generate_subscripts(x, 1) AS i
        FROM ft),
      st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM lg WHERE split = 'train' AND NOT is_anomaly
        GROUP BY i)
      SELECT event_id, round(sum(i * (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END), 4) AS weighted
      FROM lg JOIN st USING (i) GROUP BY event_id""",
)
def i02(spark, folder):
    fit = (F.col("split") == "train") & ~F.col("is_anomaly")
    df = standardised(feature_rows(spark, folder), "features", len(FEATURES), fit, "scaled")
    weighted = F.aggregate(
        F.transform("scaled", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b
    )
    return df.select("event_id", F.round(weighted, 4).alias("weighted"))


def _inputs(spark, folder) -> DataFrame:
    """Balanced and natural rows of the events, and cases near every threshold."""
    columns = feature_columns(ev.CHANNELS, ev.STATES)
    rows = checkpointed(
        feature_rows(spark, folder).select(
            F.col("event_id").alias("record_id"),
            "split",
            F.col("is_anomaly").alias("gold"),
            "features",
        )
    )
    cases = assemble(near_cases(spark, folder), columns).select(
        F.xxhash64("user_id", "rule", "state", "offset").alias("record_id"), "gold", "features"
    )
    return study_rows(rows, cases, SEED)


# The rows of every data set: balanced ones by rank of the seeded key, natural ones, cases.
_STUDY = _CASES + """, wanted AS (SELECT split, count(*) FILTER (WHERE is_anomaly) AS n FROM lab GROUP BY split),
      rk AS (SELECT *, row_number() OVER (PARTITION BY split, is_anomaly
        ORDER BY sha256('42:' || event_id)) AS place FROM lab),
      study AS (
        SELECT CASE rk.split WHEN 'test' THEN 'test_balanced' ELSE rk.split END AS dataset,
          event_id, is_anomaly AS gold FROM rk JOIN wanted USING (split) WHERE is_anomaly OR place <= n
        UNION ALL SELECT 'test_natural', event_id, is_anomaly FROM lab WHERE split = 'test'
        UNION ALL SELECT 'boundary', NULL, gold FROM cl)
"""


@query(
    "i03_isolation_forest",
    _STUDY + """SELECT dataset, CASE WHEN dataset <> 'boundary' THEN event_id END AS event_id, gold,
      true AS scored, true AS verdict_follows FROM study""",
)
def i03(spark, folder):
    """Every row of every data set scored by the forest; SQL knows the rows, not the scores."""
    predictions, _ = isolation_forest_baseline(_inputs(spark, folder), len(FEATURES))
    score = F.col("score")
    return predictions.select(
        "dataset",
        F.when(F.col("dataset") != "boundary", F.col("record_id")).alias("event_id"),
        "gold",
        ((score > 0) & (score <= 1)).alias("scored"),
        (F.col("pred") == (score >= F.col("threshold"))).alias("verdict_follows"),
    )


@query(
    "i04_random_forest_importance",
    "SELECT unnest([" + ", ".join(f"'{name}'" for name in FEATURES)
    + "]) AS feature, true AS is_share, 1.0::DOUBLE AS total",
)
def i04(spark, folder):
    """Importance of each feature; SQL knows the features and that the shares add up to one."""
    _, _, importance = random_forest_baseline(_inputs(spark, folder), FEATURES)
    return importance.select(
        "feature",
        F.col("importance").between(0, 1).alias("is_share"),
        F.round(F.sum("importance").over(Window.partitionBy(F.lit(0))), 9).alias("total"),
    )


@query(
    "i05_baseline_comparison",
    _STUDY + """SELECT method, dataset, count(*) AS samples, count(*) FILTER (WHERE gold) AS positives,
        true AS counts_agree, true AS separates
      FROM study, (VALUES ('isolation_forest'), ('random_forest')) m(method) GROUP BY ALL""",
)
def i05(spark, folder):
    """Both forests on every data set, with the confusion counted again from the predictions."""
    rows = _inputs(spark, folder)
    first, isolation = isolation_forest_baseline(rows, len(FEATURES))
    second, forest, _ = random_forest_baseline(rows, FEATURES)
    again = first.unionByName(second).groupBy("method", "dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("gold")).alias("positives"),
        F.count_if(F.col("gold") & F.col("pred")).alias("a_tp"),
        F.count_if(~F.col("gold") & F.col("pred")).alias("a_fp"),
    )
    metrics = isolation.unionByName(forest).join(again, ["method", "dataset"])
    agree = (
        (F.col("tp") == F.col("a_tp")) & (F.col("fp") == F.col("a_fp"))
        & (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") == F.col("n"))
    )
    # ranks better than chance on the rows it was made for
    separates = (F.col("dataset") == "boundary") | (F.col("auroc") > 0.5)
    return metrics.select(
        "method", "dataset", F.col("n").alias("samples"), "positives",
        agree.alias("counts_agree"), separates.alias("separates"),
    )


@query("i03_isolation_predictions")
def i03_predictions(spark, folder):
    """Score, threshold and verdict of the isolation forest for every row of every data set."""
    predictions, _ = isolation_forest_baseline(_inputs(spark, folder), len(FEATURES))
    return predictions.select("dataset", "record_id", "gold", "score", "threshold", "pred")


@query("i04_feature_importances")
def i04_importances(spark, folder):
    """The importance of each feature in the random forest."""
    _, _, importance = random_forest_baseline(_inputs(spark, folder), FEATURES)
    return importance.select("feature", "importance")


@query("i05_baseline_metrics")
def i05_metrics(spark, folder):
    """Confusion, rates, AUROC and average precision of both forests on every data set."""
    rows = _inputs(spark, folder)
    _, isolation = isolation_forest_baseline(rows, len(FEATURES))
    _, forest, _ = random_forest_baseline(rows, FEATURES)
    return isolation.unionByName(forest)
