"""Evaluation of verdict and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepguard.operators import align
from stepguard.operators import evaluate as ea
from stepguard.operators.rules import (
    any_rule,
    band_members,
    isolated,
    label_variants,
    variants_long,
)
from stepguard.operators.splits import SPLITS
from stepguard.plans import events as ev
from stepguard.plans.catalog.registry import BAND, LAB, PRED, query
from stepguard.plans.verification import near_threshold_report
from stepguard.session import checkpointed

METHODS = ["k_jump", "no_r1", "value", "value_jump"]
KEYS = ["method", "dataset"]


def predictions(spark, folder) -> DataFrame:
    """Verdicts of four simple methods on every event; the dataset is the split."""
    return verdicts(ev.labelled_events(spark, folder))


def verdicts(df: DataFrame, record_id: str = "event_id") -> DataFrame:
    without_r1 = any_rule(["r2", "r3", "r4", "r5"])
    methods = {
        "k_jump": (F.coalesce("k_diff", F.lit(0.0)), 80.0),
        "no_r1": (F.when(without_r1, 1.0).otherwise(0.0), 0.5),
        "value": (F.col("value"), 200.0),
        "value_jump": (F.coalesce("value_diff", F.lit(0.0)), 100.0),
    }
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("method"), score.alias("score"), (score >= t).alias("pred"))
            for name, (score, t) in methods.items()
        ]
    )
    return df.select(
        F.col(record_id).alias("record_id"),
        F.col("split").alias("dataset"),
        F.col("is_anomaly").alias("gold"),
        F.col("state"),
        F.inline(entries),
    )


def rounded(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_CELLS = """count(pred) AS samples, count(*) FILTER (WHERE gold AND pred) AS tp,
  count(*) FILTER (WHERE NOT gold AND pred) AS fp, count(*) FILTER (WHERE NOT gold AND NOT pred) AS tn,
  count(*) FILTER (WHERE gold AND NOT pred) AS fn, count(*) FILTER (WHERE pred IS NULL) AS unparsed"""

_RATES = """round((tp + fn) / samples, 9) AS prevalence, round((tp + tn) / samples, 9) AS accuracy,
  round({e}(tp / nullif(tp + fp, 0){z}), 9) AS precision,
  round({e}(tp / nullif(tp + fn, 0){z}), 9) AS recall,
  round({e}(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END{z}), 9) AS f1,
  round(fp / nullif(fp + tn, 0), 9) AS fpr, round(fn / nullif(fn + tp, 0), 9) AS fnr,
  round(tn / nullif(tn + fp, 0), 9) AS specificity"""

RATES = ["prevalence", "accuracy", "precision", "recall", "f1", "fpr", "fnr", "specificity"]


@query(
    "d12_confusion_metrics",
    PRED + f""", c AS (SELECT method, dataset, {_CELLS} FROM pred GROUP BY ALL)
      SELECT *, {_RATES.format(e='coalesce', z=', 0')} FROM c""",
)
def d12(spark, folder):
    out = ea.metrics(predictions(spark, folder), KEYS, "gold", "pred", "mixed")
    return rounded(out, RATES)


@query(
    "d13_metrics_without_unparsed",
    PRED + f""", st AS (SELECT event_id AS record_id, state FROM lab),
      p AS (SELECT method, gold, CASE WHEN state <> 'view' THEN pred END AS pred
            FROM pred JOIN st USING (record_id)),
      c AS (SELECT method, {_CELLS} FROM p GROUP BY ALL)
      SELECT *, {_RATES.format(e='', z='')} FROM c""",
)
def d13(spark, folder):
    df = predictions(spark, folder).withColumn("pred", F.when(F.col("state") != "view", F.col("pred")))
    return rounded(ea.metrics(df, ["method"], "gold", "pred", "null"), RATES)


_CURVE = PRED + """, pts AS (SELECT method, dataset, score, count(*) FILTER (WHERE gold) AS pos,
        count(*) FILTER (WHERE NOT gold) AS neg FROM pred GROUP BY ALL),
      cur AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp,
          sum(pos) OVER (PARTITION BY method, dataset) AS p,
          sum(neg) OVER (PARTITION BY method, dataset) AS n FROM pts
        WINDOW w AS (PARTITION BY method, dataset ORDER BY score DESC))
"""


@query(
    "d14_d15_auroc_average_precision",
    _CURVE + """SELECT method, dataset,
        round(1 - sum(pos * (cfp - neg / 2)) / nullif(max(p) * max(n), 0), 9) AS auroc,
        round(sum(pos * ctp / (ctp + cfp)) / nullif(max(p), 0), 9) AS auprc
      FROM cur GROUP BY ALL""",
)
def d14(spark, folder):
    curve = ea.score_curve(predictions(spark, folder), KEYS, "gold", "score")
    return rounded(ea.ranking_metrics(curve, KEYS), ["auroc", "auprc"])


@query(
    "d14_label_ranking",
    """WITH c AS (SELECT 1 - quality AS score, count(*) FILTER (WHERE toxic = 1) AS pos,
         count(*) FILTER (WHERE toxic = 0) AS neg FROM labels GROUP BY 1),
       cur AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS ctp,
         sum(neg) OVER (ORDER BY score DESC) AS cfp FROM c)
       SELECT round(1 - sum(pos * (cfp - neg / 2)) / (sum(pos) * sum(neg)), 9) AS auroc,
         round(sum(pos * ctp / (ctp + cfp)) / sum(pos), 9) AS auprc FROM cur""",
)
def d14_labels(spark, folder):
    df = ev.table(spark, folder, "labels").select(
        (F.col("toxic") == 1).alias("gold"), (1 - F.col("quality")).cast("double").alias("score")
    )
    curve = ea.score_curve(df, [], "gold", "score")
    return rounded(ea.ranking_metrics(curve, []), ["auroc", "auprc"])


@query(
    "d16_tuned_threshold",
    _CURVE + """SELECT method, dataset, threshold, round(precision, 9) AS precision,
        round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (
        SELECT *, score AS threshold, ctp / (ctp + cfp) AS precision, ctp / p AS recall,
          CASE WHEN ctp > 0 THEN 2.0 * (ctp / (ctp + cfp)) * (ctp / p)
            / (ctp / (ctp + cfp) + ctp / p) ELSE 0 END AS f1 FROM cur)
      QUALIFY row_number() OVER (PARTITION BY method, dataset ORDER BY f1 DESC, threshold DESC) = 1""",
)
def d16(spark, folder):
    curve = ea.score_curve(predictions(spark, folder), KEYS, "gold", "score")
    return rounded(ea.tune_threshold(curve, KEYS), ["precision", "recall", "f1"])


# Bisection for the bounds: the tail P(X >= k) or P(X <= k) sums binomial terms in log space.
# Exact bounds of the cells in ``acc`` (samples, correct), by halving the tail sums.
_BOUNDS = """
      terms AS (SELECT *, range(correct, samples + 1) AS upper, range(0, correct + 1) AS lower FROM acc),
      logs AS (SELECT *,
        list_transform(upper, lambda i: lgamma(samples + 1.0) - lgamma(i + 1.0) - lgamma(samples - i + 1.0)) AS lu,
        list_transform(lower, lambda i: lgamma(samples + 1.0) - lgamma(i + 1.0) - lgamma(samples - i + 1.0)) AS ll
        FROM terms),
      bounds AS (SELECT *,
        list_reduce(range(0, 48), lambda s, i: CASE WHEN list_sum(list_transform(upper, lambda j, n:
            exp(lu[n] + j * ln(s + power(0.5, i + 2)) + (samples - j) * ln(1 - s - power(0.5, i + 2)))))
            < 0.025 THEN s + power(0.5, i + 2) ELSE s END,
          CASE WHEN list_sum(list_transform(upper, lambda j, n: exp(lu[n] + samples * ln(0.5)))) < 0.025
            THEN 0.5 ELSE 0.0 END) AS low,
        list_reduce(range(0, 48), lambda s, i: CASE WHEN list_sum(list_transform(lower, lambda j, n:
            exp(ll[n] + j * ln(s + power(0.5, i + 2)) + (samples - j) * ln(1 - s - power(0.5, i + 2)))))
            > 0.025 THEN s + power(0.5, i + 2) ELSE s END,
          CASE WHEN list_sum(list_transform(lower, lambda j, n: exp(ll[n] + samples * ln(0.5)))) > 0.025
            THEN 0.5 ELSE 0.0 END) AS high FROM logs)
"""

_INTERVAL = PRED + """, acc AS (SELECT method, dataset, count(*) AS samples,
        count(*) FILTER (WHERE pred = gold) AS correct,
        count(*) FILTER (WHERE pred <> gold) AS errors FROM pred GROUP BY ALL),""" + _BOUNDS + """
      SELECT method, dataset, samples, correct, errors, round(correct / samples, 8) AS accuracy,
        round(CASE WHEN correct = 0 THEN 0 ELSE low END, 8) AS accuracy_exact_ci_lower,
        round(CASE WHEN correct = samples THEN 1 ELSE high END, 8) AS accuracy_exact_ci_upper FROM bounds
"""


@query("d17_exact_interval", _INTERVAL)
def d17(spark, folder):
    table = ea.accuracy_table(predictions(spark, folder), KEYS, "gold", "pred")
    out = ea.with_exact_interval(table, F.col("correct"), F.col("samples"))
    numbers = ["accuracy", "accuracy_exact_ci_lower", "accuracy_exact_ci_upper"]
    return rounded(out, numbers, 8)


_PAIRS = PRED + """, pr AS (SELECT a.dataset, a.method AS first, b.method AS second,
        count(*) FILTER (WHERE a.pred = a.gold AND b.pred <> b.gold) AS first_correct_second_wrong,
        count(*) FILTER (WHERE a.pred <> a.gold AND b.pred = b.gold) AS first_wrong_second_correct,
        count(*) FILTER (WHERE a.pred = a.gold AND b.pred = b.gold) AS both_right,
        count(*) FILTER (WHERE a.pred <> a.gold AND b.pred <> b.gold) AS both_wrong
      FROM pred a JOIN pred b ON a.record_id = b.record_id AND a.method < b.method GROUP BY ALL),
      tst AS (SELECT *, first_correct_second_wrong + first_wrong_second_correct AS discordant,
        least(first_correct_second_wrong, first_wrong_second_correct) AS lo FROM pr),
      mc AS (SELECT * EXCLUDE (lo), CASE WHEN first_correct_second_wrong = first_wrong_second_correct
          THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, lo + 1), lambda i:
            exp(lgamma(discordant + 1.0) - lgamma(i + 1.0) - lgamma(discordant - i + 1.0)
                - discordant * ln(2.0))))) END AS exact_two_sided_p FROM tst)
"""


def paired(spark, folder) -> DataFrame:
    patterns = ea.verdict_patterns(
        predictions(spark, folder), ["dataset"], "record_id", "method", "gold", "pred", METHODS
    )
    return ea.add_mcnemar(ea.paired_counts(patterns, ["dataset"], METHODS))


@query(
    "d18_e07_mcnemar_all_pairs",
    _PAIRS + """SELECT * REPLACE (round(exact_two_sided_p, 9) AS exact_two_sided_p) FROM mc""",
)
def d18(spark, folder):
    return rounded(paired(spark, folder), ["exact_two_sided_p"])


@query(
    "c11_holm_adjusted",
    _PAIRS + """, rk AS (SELECT dataset, first, second, p,
        row_number() OVER (PARTITION BY dataset ORDER BY p, first, second) AS holm_rank,
        count(*) OVER (PARTITION BY dataset) AS m
        FROM (SELECT *, round(exact_two_sided_p, 12) AS p FROM mc))
      SELECT dataset, first, second, holm_rank::INTEGER AS holm_rank,
        round(max(least(1.0, (m - holm_rank + 1) * p))
          OVER (PARTITION BY dataset ORDER BY holm_rank), 9) AS holm_adjusted_p FROM rk""",
)
def c11(spark, folder):
    # Equal p values may differ in the last bit; rounding keeps their order by name.
    tests = rounded(paired(spark, folder), ["exact_two_sided_p"], 12)
    out = ea.holm(tests, ["dataset"], "exact_two_sided_p", ["first", "second"])
    out = rounded(out, ["holm_adjusted_p"])
    return out.select("dataset", "first", "second", "holm_rank", "holm_adjusted_p")


@query(
    "d19_accuracy_by_case_type",
    PRED + """, st AS (SELECT event_id AS record_id, state AS case_type FROM lab)
      SELECT case_type, method, count(*) AS samples, count(*) FILTER (WHERE pred = gold) AS correct,
        count(*) FILTER (WHERE pred <> gold) AS errors,
        round(count(*) FILTER (WHERE pred = gold) / count(*), 9) AS accuracy
      FROM pred JOIN st USING (record_id) GROUP BY ALL""",
)
def d19(spark, folder):
    df = predictions(spark, folder).withColumnRenamed("state", "case_type")
    return rounded(ea.accuracy_table(df, ["case_type", "method"], "gold", "pred"), ["accuracy"])


def near_predictions(labelled: DataFrame) -> DataFrame:
    """Records near a threshold, for all of them and the isolated ones."""
    near = band_members(
        labelled, ev.RULES, ["event_id", "rule_triggers", "is_anomaly"]
    ).filter("window_name = 'primary'")
    scopes = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(isolated(F.col("rule_triggers"), F.col("rule")), F.lit("isolated")),
        )
    )
    return near.withColumn("scope", F.explode(scopes)).withColumnRenamed("event_id", "record_id")


_NEAR = """, near AS (SELECT event_id AS record_id, rule, side, is_anomaly, rule_triggers,
        unnest(CASE WHEN len(list_filter(rule_triggers, lambda x: x <> rule)) = 0
          THEN ['all', 'isolated'] ELSE ['all'] END) AS scope
      FROM band WHERE window_name = 'primary')
"""

# Verdicts of the four methods on every event.
_SCORED = """, p AS (SELECT event_id AS record_id, is_anomaly AS gold, m.method, m.pred
        FROM lab, LATERAL (VALUES ('k_jump', coalesce(k_diff, 0) >= 80),
          ('no_r1', r2 OR r3 OR r4 OR r5), ('value', value >= 200),
          ('value_jump', coalesce(value_diff, 0) >= 100)) m(method, pred))"""



@query(
    "d20_accuracy_by_threshold_side",
    BAND + _NEAR + _SCORED + """,
      grid AS (SELECT * FROM (VALUES ('k_jump'), ('no_r1'), ('value'), ('value_jump')) a(method),
        (VALUES ('r1'),('r2'),('r3'),('r4'),('r5')) b(rule), (VALUES ('all'),('isolated')) c(scope),
        (VALUES ('below_or_equal'),('above')) d(side)),
      j AS (SELECT * FROM near JOIN p USING (record_id)),
      acc AS (SELECT g.method, g.rule, g.scope, g.side, count(j.record_id) AS samples,
          count(*) FILTER (WHERE j.pred = j.gold) AS correct
        FROM grid g LEFT JOIN j USING (method, rule, scope, side) GROUP BY ALL),""" + _BOUNDS + """
      SELECT method, rule, scope, side, samples, correct, round(correct / nullif(samples, 0), 8) AS accuracy,
        round(CASE WHEN samples = 0 THEN NULL WHEN correct = 0 THEN 0 ELSE low END, 8)
          AS accuracy_exact_ci_lower,
        round(CASE WHEN samples = 0 THEN NULL WHEN correct = samples THEN 1 ELSE high END, 8)
          AS accuracy_exact_ci_upper FROM bounds""",
)
def d20(spark, folder):
    labelled = checkpointed(ev.labelled_events(spark, folder))
    preds = verdicts(labelled).select("record_id", "method", "gold", "pred")
    joined = near_predictions(labelled).join(preds, "record_id")
    axes = {
        "method": METHODS,
        "rule": ev.RULE_NAMES,
        "scope": ["all", "isolated"],
        "side": ["below_or_equal", "above"],
    }
    out = ea.dense_accuracy_table(joined, axes, "gold", "pred")
    return rounded(out, ["accuracy", "accuracy_exact_ci_lower", "accuracy_exact_ci_upper"], 8)


@query(
    "d18_near_threshold_tests",
    BAND + _NEAR + _SCORED + """,
      j AS (SELECT record_id, rule, scope, method, pred, gold FROM near JOIN p USING (record_id)),
      pr AS (SELECT a.rule, a.scope, a.method AS first, b.method AS second,
          count(*) FILTER (WHERE a.pred = a.gold AND b.pred <> b.gold) AS one,
          count(*) FILTER (WHERE a.pred <> a.gold AND b.pred = b.gold) AS two
        FROM j a JOIN j b ON a.record_id = b.record_id AND a.rule = b.rule AND a.scope = b.scope
          AND a.method < b.method GROUP BY ALL),
      mc AS (SELECT *, CASE WHEN one = two THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(
          range(0, least(one, two) + 1), lambda i: exp(lgamma(one + two + 1.0) - lgamma(i + 1.0)
            - lgamma(one + two - i + 1.0) - (one + two) * ln(2.0))))) END AS p FROM pr),
      rk AS (SELECT *, row_number() OVER (PARTITION BY rule, scope ORDER BY p, first, second) AS place,
          count(*) OVER (PARTITION BY rule, scope) AS m FROM mc)
      SELECT rule, scope, first, second, one AS first_correct_second_wrong,
        two AS first_wrong_second_correct, round(p, 9) AS exact_two_sided_p,
        round(max(least(1.0, (m - place + 1) * p)) OVER (PARTITION BY rule, scope ORDER BY place), 9)
          AS holm_adjusted_p FROM rk""",
)
def d18_near(spark, folder):
    """The paired tests of the near-threshold report, with step-down correction per rule and scope."""
    labelled = checkpointed(ev.labelled_events(spark, folder).withColumnRenamed("event_id", "record_id"))
    preds = verdicts(labelled, "record_id").withColumnRenamed("score", "anomaly_score")
    paired = near_threshold_report(labelled, preds, ev.RULES, METHODS).paired
    return rounded(paired, ["exact_two_sided_p", "holm_adjusted_p"]).select(
        "rule", "scope", "first", "second", "first_correct_second_wrong", "first_wrong_second_correct",
        "exact_two_sided_p", "holm_adjusted_p",
    )


@query(
    "d21_near_band_manifest",
    BAND + _NEAR + """SELECT rule, scope, count(*) AS samples,
        count(*) FILTER (WHERE side = 'below_or_equal') AS below_or_equal,
        count(*) FILTER (WHERE side = 'above') AS above,
        count(*) FILTER (WHERE NOT is_anomaly) AS gold_normal,
        count(*) FILTER (WHERE is_anomaly) AS gold_anomaly,
        count(*) FILTER (WHERE len(list_filter(rule_triggers, lambda x: x <> rule)) > 0)
          AS records_with_other_rule_triggers
      FROM near GROUP BY ALL""",
)
def d21(spark, folder):
    others = ~isolated(F.col("rule_triggers"), F.col("rule"))
    return near_predictions(ev.labelled_events(spark, folder)).groupBy("rule", "scope").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("side") == "below_or_equal").alias("below_or_equal"),
        F.count_if(F.col("side") == "above").alias("above"),
        F.count_if(~F.col("is_anomaly")).alias("gold_normal"),
        F.count_if(F.col("is_anomaly")).alias("gold_anomaly"),
        F.count_if(others).alias("records_with_other_rule_triggers"),
    )


@query(
    "d22_override_accounting",
    PRED + """, v AS (SELECT *, gold <> (record_id % 7 = 0) AS ruled FROM pred)
      SELECT method, dataset, count(*) AS samples,
        round(count(*) FILTER (WHERE gold) / count(*), 9) AS prevalence,
        round(count(*) FILTER (WHERE pred = gold) / count(*), 9) AS model_accuracy,
        count(*) FILTER (WHERE NOT gold AND pred) AS model_fp,
        count(*) FILTER (WHERE gold AND NOT pred) AS model_fn,
        count(*) FILTER (WHERE pred <> ruled) AS inconsistencies,
        count(*) FILTER (WHERE pred <> ruled AND pred <> gold) AS corrected_model_errors,
        count(*) FILTER (WHERE pred <> ruled AND pred = gold) AS unnecessary_overrides,
        count(*) FILTER (WHERE gold AND ruled) AS final_tp,
        count(*) FILTER (WHERE NOT gold AND ruled) AS final_fp,
        count(*) FILTER (WHERE NOT gold AND NOT ruled) AS final_tn,
        count(*) FILTER (WHERE gold AND NOT ruled) AS final_fn,
        round(count(*) FILTER (WHERE gold = ruled) / count(*), 9) AS final_accuracy
      FROM v GROUP BY ALL""",
)
def d22(spark, folder):
    """Overrides by a rule verdict that is wrong on every seventh record."""
    wrong = F.col("record_id") % 7 == 0
    df = predictions(spark, folder).withColumn("rule_pred", F.col("gold") != wrong)
    out = ea.overrides(df, KEYS, "gold", "pred", "rule_pred", "rule_pred")
    return rounded(out, ["prevalence", "model_accuracy", "final_accuracy"])


@query(
    "d31_wide_comparison",
    PRED + """, c AS (SELECT method, dataset, count(*) FILTER (WHERE pred = gold) / count(*) AS accuracy,
        count(*) FILTER (WHERE pred <> gold) AS errors FROM pred GROUP BY ALL)
      SELECT method, round(max(accuracy) FILTER (WHERE dataset = 'train'), 9) AS train_accuracy,
        max(errors) FILTER (WHERE dataset = 'train') AS train_errors,
        round(max(accuracy) FILTER (WHERE dataset = 'val'), 9) AS val_accuracy,
        max(errors) FILTER (WHERE dataset = 'val') AS val_errors,
        round(max(accuracy) FILTER (WHERE dataset = 'test'), 9) AS test_accuracy,
        max(errors) FILTER (WHERE dataset = 'test') AS test_errors FROM c GROUP BY method""",
)
def d31(spark, folder):
    table = ea.accuracy_table(predictions(spark, folder), KEYS, "gold", "pred")
    table = rounded(table, ["accuracy"])
    return ea.wide_comparison(table, "method", "dataset", SPLITS, ["accuracy", "errors"])


@query(
    "e02_prediction_join",
    PRED + """SELECT p.record_id, p.method, p.pred, lab.is_anomaly AS rule_pred
      FROM pred p JOIN lab ON lab.event_id = p.record_id""",
)
def e02(spark, folder):
    labelled = checkpointed(ev.labelled_events(spark, folder))
    preds = verdicts(labelled)
    reference = labelled.select(
        F.col("event_id").alias("record_id"), F.col("is_anomaly").alias("rule_pred")
    )
    return preds.join(reference, "record_id").select("record_id", "method", "pred", "rule_pred")


@query(
    "e03_alignment_audit",
    LAB + """, ref AS (SELECT event_id AS record_id, is_anomaly AS gold FROM lab WHERE state <> 'view'),
      p AS (SELECT event_id AS record_id, is_anomaly <> (k > 98) AS gold, value AS score,
              value > 150 AS pred FROM lab WHERE state <> 'click'
            UNION ALL SELECT event_id, is_anomaly, value, value > 150 FROM lab WHERE r1),
      l AS (SELECT record_id, count(*) AS n, bool_or(gold) AS gold FROM ref GROUP BY ALL),
      r AS (SELECT record_id, count(*) AS n, bool_or(gold) AS gold,
              count(*) FILTER (WHERE pred <> (score >= 150.21)) AS differs FROM p GROUP BY record_id)
      SELECT count(*) FILTER (WHERE r.n IS NULL) AS reference_only,
        count(*) FILTER (WHERE l.n IS NULL) AS prediction_only,
        count(*) FILTER (WHERE l.n > 1) AS duplicate_reference_ids,
        count(*) FILTER (WHERE r.n > 1) AS duplicate_prediction_ids,
        count(*) FILTER (WHERE l.gold <> r.gold) AS gold_mismatches,
        sum(differs)::BIGINT AS verdict_mismatches, 0::BIGINT AS nonfinite_scores
      FROM l FULL JOIN r USING (record_id)""",
)
def e03(spark, folder):
    df = ev.labelled_events(spark, folder).withColumnRenamed("event_id", "record_id")
    reference = df.filter("state <> 'view'").select("record_id", F.col("is_anomaly").alias("gold"))
    score = F.col("value")
    first = df.filter("state <> 'click'").select(
        "record_id",
        (F.col("is_anomaly") != (F.col("k") > 98)).alias("gold"),
        score.alias("score"),
        (score > 150).alias("pred"),
    )
    again = df.filter("r1").select(
        "record_id", F.col("is_anomaly").alias("gold"), score.alias("score"), (score > 150).alias("pred")
    )
    return align.alignment_audit(
        reference, first.unionByName(again), "record_id", "gold", "pred", "score", 150.21
    )


@query(
    "e08_metric_check",
    PRED + """, c AS (SELECT method, dataset, count(*) FILTER (WHERE pred = gold) / count(*) AS v
        FROM pred GROUP BY ALL)
      SELECT method, dataset, method <> 'value' AND dataset <> 'val' AS ok FROM c""",
)
def e08(spark, folder):
    computed = ea.accuracy_table(predictions(spark, folder), KEYS, "gold", "pred")
    shifted = F.when(F.col("method") == "value", F.col("accuracy") + 1e-6).otherwise(
        F.col("accuracy") + 1e-14
    )
    stored = computed.filter("dataset <> 'val'").withColumn("accuracy", shifted)
    return align.metric_check(stored, computed, KEYS, "accuracy").select(*KEYS, "ok")


@query(
    "e10_ordered_alignment",
    """SELECT count(a.event_id) AS left_rows, count(b.event_id) AS right_rows,
        count(*) FILTER (WHERE a.event_id IS DISTINCT FROM b.event_id) AS mismatched_positions
      FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS p FROM events) a
      FULL JOIN (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS p FROM events
                 WHERE value < 300) b USING (p)""",
)
def e10(spark, folder):
    df = ev.events(spark, folder)
    return align.order_check(df, df.filter("value < 300"), ["event_id"], ev.ORDER)


@query(
    "e11_rescored_variants",
    LAB + f""", v AS (SELECT value >= 150 AS pred, variant, CASE variant
        WHEN 'original_all_rules' THEN is_anomaly WHEN 'remove_r1' THEN r2 OR r3 OR r4 OR r5
        WHEN 'remove_r3' THEN r1 OR r2 OR r4 OR r5 WHEN 'remove_r5' THEN r1 OR r2 OR r3 OR r4
        ELSE r2 OR r3 OR r4 END AS gold
      FROM lab, (VALUES ('original_all_rules'), ('remove_r1'), ('remove_r3'), ('remove_r5'),
                        ('remove_r1_r5')) v(variant)),
      c AS (SELECT 'value' AS method, variant, {_CELLS} FROM v GROUP BY ALL)
      SELECT method, variant, tp, fp, tn, fn, tp + fn AS positive, round((tp + tn) / samples, 9)
        AS accuracy FROM c""",
)
def e11(spark, folder):
    df = checkpointed(ev.labelled_events(spark, folder).withColumnRenamed("event_id", "record_id"))
    labels = variants_long(df, label_variants(ev.RULES, ev.REMOVALS), ["record_id"])
    preds = df.select("record_id", F.lit("value").alias("method"), (F.col("value") >= 150).alias("pred"))
    out = ea.rescored(preds, labels, "record_id", ["method"], "pred")
    return rounded(out, ["accuracy"]).select(
        "method", "variant", "tp", "fp", "tn", "fn", "positive", "accuracy"
    )


@query(
    "e12_case_table",
    PRED + """SELECT record_id, gold,
        bool_or(pred) FILTER (WHERE method = 'value') AS value_pred,
        round(max(score) FILTER (WHERE method = 'value'), 6) AS value_score,
        bool_or(pred) FILTER (WHERE method = 'value_jump') AS value_jump_pred,
        round(max(score) FILTER (WHERE method = 'value_jump'), 6) AS value_jump_score,
        bool_or(pred) FILTER (WHERE method = 'no_r1') AS no_r1_pred,
        round(max(score) FILTER (WHERE method = 'no_r1'), 6) AS no_r1_score,
        bool_or(pred) FILTER (WHERE method = 'k_jump') AS k_jump_pred,
        round(max(score) FILTER (WHERE method = 'k_jump'), 6) AS k_jump_score
      FROM pred WHERE gold GROUP BY ALL""",
)
def e12(spark, folder):
    df = rounded(predictions(spark, folder).filter("gold"), ["score"], 6)
    return ea.case_table(
        df, "record_id", ["gold"], "method", METHODS, ["pred", "score"]
    )
