"""Data-validity profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepguard.functions.numbers import one_hot
from stepguard.operators import profile as pf
from stepguard.operators.adjacent import add_steps, rolling_sequence
from stepguard.operators.rules import add_labels, label_variants, restricted
from stepguard.operators.splits import SPLITS
from stepguard.plans import events as ev
from stepguard.plans.catalog.registry import BAND, LAB, query

FEATURES = ["value", "value_diff", "k", "k_diff"]
STEP_FEATURES = ["state_purchase", "state_error", "state_other", "value", "k"]

_DENSE = """, lab2 AS (SELECT *, unnest([split, 'all']) AS part FROM lab),
parts(part) AS (VALUES ('all'), ('train'), ('val'), ('test'))
"""


@query(
    "d01_group_profile",
    LAB + """SELECT user_id, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomaly,
      min(event_id) AS first_record_id, max(event_id) AS last_record_id,
      min(ts_us) AS min_timestamp, max(ts_us) AS max_timestamp FROM lab GROUP BY user_id""",
)
def d01(spark, folder):
    df = ev.labelled_events(spark, folder)
    return pf.group_profile(df, "user_id", "event_id", "ts_us", "is_anomaly")


@query(
    "d02_split_statistics",
    LAB + """SELECT split, count(DISTINCT user_id) AS groups, count(*) AS total,
      count(*) FILTER (WHERE is_anomaly) AS anomaly, count(*) FILTER (WHERE NOT is_anomaly) AS normal,
      round(count(*) FILTER (WHERE is_anomaly) / count(*), 9) AS anomaly_rate,
      2 * least(count(*) FILTER (WHERE is_anomaly), count(*) FILTER (WHERE NOT is_anomaly))
        AS balanced_subset_size,
      min(event_id) AS first_record_id, max(event_id) AS last_record_id,
      min(ts_us) AS min_timestamp, max(ts_us) AS max_timestamp FROM lab GROUP BY split""",
)
def d02(spark, folder):
    df = ev.labelled(ev.events(spark, folder))
    profiles = pf.group_profile(df, "user_id", "event_id", "ts_us", "is_anomaly")
    marked = ev.with_buckets(profiles.withColumn("state", F.lit(None).cast("string")))
    return pf.split_statistics(marked).withColumn("anomaly_rate", F.round("anomaly_rate", 9))


@query(
    "d03_state_distribution",
    LAB + _DENSE + """, b(bucket) AS (VALUES ('a'), ('b'), ('other')),
      c AS (SELECT part, bucket, count(*) AS n FROM lab2 GROUP BY ALL)
      SELECT parts.part AS split, b.bucket, coalesce(c.n, 0) AS n,
        round(coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY parts.part), 9)
          AS proportion
      FROM parts CROSS JOIN b LEFT JOIN c ON c.part = parts.part AND c.bucket = b.bucket""",
)
def d03(spark, folder):
    df = ev.with_buckets(ev.events(spark, folder))
    out = pf.state_distribution(df, "split", "bucket", SPLITS, ev.BUCKETS)
    return out.withColumn("proportion", F.round("proportion", 9))


@query(
    "d04_trigger_counts",
    LAB + _DENSE + """, u AS (SELECT part, unnest(rule_triggers) AS rule FROM lab2),
      c AS (SELECT part, rule, count(*) AS n FROM u GROUP BY ALL)
      SELECT parts.part AS split, r.rule, coalesce(c.n, 0) AS triggered
      FROM parts CROSS JOIN (VALUES ('r1'),('r2'),('r3'),('r4'),('r5')) r(rule)
      LEFT JOIN c ON c.part = parts.part AND c.rule = r.rule""",
)
def d04(spark, folder):
    return pf.trigger_counts(ev.labelled_events(spark, folder), ev.RULE_NAMES, "split", SPLITS)


@query(
    "d05_unique_trigger_counts",
    LAB + """SELECT r.rule, count(lab.event_id) AS unique_triggers
      FROM (VALUES ('r1'),('r2'),('r3'),('r4'),('r5')) r(rule)
      LEFT JOIN lab ON len(rule_triggers) = 1 AND rule_triggers[1] = r.rule GROUP BY r.rule""",
)
def d05(spark, folder):
    return pf.unique_trigger_counts(
        ev.labelled_events(spark, folder), "rule_triggers", ev.RULE_NAMES
    )


@query(
    "d06_rule_overlap",
    LAB + """SELECT count(*) FILTER (WHERE r1) AS first_trigger,
      count(*) FILTER (WHERE r3) AS second_trigger, count(*) FILTER (WHERE r1 AND r3) AS both,
      count(*) FILTER (WHERE r1 AND NOT r3) AS first_only,
      count(*) FILTER (WHERE r3 AND NOT r1) AS second_only FROM lab""",
)
def d06(spark, folder):
    return pf.overlap(ev.labelled_events(spark, folder), "r1", "r3")


@query(
    "d07_column_redundancy",
    LAB + """SELECT 'values' AS pair, count(value - k) AS pairs,
        count(*) FILTER (WHERE value = k) AS exact_equal,
        round(count(*) FILTER (WHERE value = k) / nullif(count(value - k), 0), 9) AS exact_equal_rate,
        round(max(abs(value - k)), 6) AS max_abs_difference FROM lab
      UNION ALL SELECT 'differences', count(value_diff - k_diff),
        count(*) FILTER (WHERE value_diff = k_diff),
        round(count(*) FILTER (WHERE value_diff = k_diff) / nullif(count(value_diff - k_diff), 0), 9),
        round(max(abs(value_diff - k_diff)), 6) FROM lab""",
)
def d07(spark, folder):
    pairs = {"values": ("value", "k"), "differences": ("value_diff", "k_diff")}
    out = pf.redundancy(ev.labelled_events(spark, folder), pairs)
    return out.withColumns(
        {
            "exact_equal_rate": F.round("exact_equal_rate", 9),
            "max_abs_difference": F.round("max_abs_difference", 6),
        }
    )


@query(
    "d08_threshold_coverage",
    BAND + """, parts(part) AS (VALUES ('all'), ('train'), ('val'), ('test')),
      band2 AS (SELECT *, unnest([split, 'all']) AS part FROM band)
      SELECT s.rule, s.window_name, parts.part AS split, s.feature, s.threshold, s.half_width,
        count(b.event_id) AS total,
        count(*) FILTER (WHERE b.side = 'below_or_equal') AS below_or_equal,
        count(*) FILTER (WHERE b.side = 'above') AS above,
        count(*) FILTER (WHERE NOT b.is_anomaly) AS label_normal,
        count(*) FILTER (WHERE b.is_anomaly) AS label_anomaly,
        count(*) FILTER (WHERE b.bucket = 'a') AS state_a,
        count(*) FILTER (WHERE b.bucket = 'b') AS state_b,
        count(*) FILTER (WHERE b.bucket = 'other') AS state_other
      FROM spec s CROSS JOIN parts LEFT JOIN band2 b
        ON b.rule = s.rule AND b.window_name = s.window_name AND b.part = parts.part
      GROUP BY ALL""",
)
def d08(spark, folder):
    return pf.threshold_coverage(
        ev.labelled_events(spark, folder),
        ev.RULES,
        "split",
        "bucket",
        "is_anomaly",
        SPLITS,
        ev.BUCKETS,
    )


@query(
    "d09_rule_removal_sensitivity",
    LAB + _DENSE + """, v AS (SELECT part, variant, is_anomaly, CASE variant
        WHEN 'original_all_rules' THEN is_anomaly WHEN 'remove_r1' THEN r2 OR r3 OR r4 OR r5
        WHEN 'remove_r3' THEN r1 OR r2 OR r4 OR r5 WHEN 'remove_r5' THEN r1 OR r2 OR r3 OR r4
        ELSE r2 OR r3 OR r4 END AS label
      FROM lab2, (VALUES ('original_all_rules'), ('remove_r1'), ('remove_r3'), ('remove_r5'),
                         ('remove_r1_r5')) v(variant))
      SELECT part AS split, variant, count(*) FILTER (WHERE label) AS positive_labels,
        count(*) FILTER (WHERE label <> is_anomaly) AS changed_rows,
        abs(count(*) FILTER (WHERE label) - count(*) FILTER (WHERE is_anomaly)) AS changed_counts,
        count(*) FILTER (WHERE label) - count(*) FILTER (WHERE is_anomaly) AS change_direction
      FROM v GROUP BY ALL""",
)
def d09(spark, folder):
    variants = label_variants(ev.RULES, ev.REMOVALS)
    return pf.sensitivity(
        ev.labelled_events(spark, folder), variants, "original_all_rules", "split", SPLITS
    )


@query(
    "d10_distribution_summary",
    LAB + """, long AS (
        SELECT split, 'value' AS feature, value AS x FROM lab UNION ALL
        SELECT split, 'value_diff', value_diff FROM lab UNION ALL
        SELECT split, 'k', k FROM lab UNION ALL SELECT split, 'k_diff', k_diff FROM lab)
      SELECT split, feature, count(x) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max,
        round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
        round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.05), 6) AS p05,
        round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS p95,
        round(quantile_cont(x, 0.99), 6) AS p99 FROM long GROUP BY ALL""",
)
def d10(spark, folder):
    out = pf.distribution(ev.labelled_events(spark, folder), FEATURES, ["split"])
    numbers = [c for c in out.columns if c not in ("split", "feature", "n")]
    return out.withColumns({c: F.round(c, 6) for c in numbers})


@query(
    "d11_pearson_matrix",
    LAB + """, full_rows AS (SELECT value, value_diff, k, k_diff, 1.0::DOUBLE AS flat FROM lab
        WHERE value_diff IS NOT NULL AND k_diff IS NOT NULL AND k IS NOT NULL),
      long AS (SELECT f.a, f.x, g.b, g.y FROM full_rows r,
        LATERAL (VALUES ('value', r.value), ('value_diff', r.value_diff), ('k', r.k),
                        ('k_diff', r.k_diff), ('flat', r.flat)) f(a, x),
        LATERAL (VALUES ('value', r.value), ('value_diff', r.value_diff), ('k', r.k),
                        ('k_diff', r.k_diff), ('flat', r.flat)) g(b, y))
      SELECT a AS row_feature, b AS column_feature,
        round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 9) AS pearson_r
      FROM long GROUP BY ALL""",
)
def d11(spark, folder):
    df = ev.labelled_events(spark, folder).withColumn("flat", F.lit(1.0))
    out = pf.pearson(df, ["value", "value_diff", "k", "k_diff", "flat"])
    return out.withColumn("pearson_r", F.round("pearson_r", 9))


@query(
    "d25_label_definition_audit",
    LAB + """, g AS (SELECT event_id, coalesce(state = 'purchase' AND dv > 100, false)
          OR coalesce(state = 'purchase' AND dk > 80, false) OR coalesce(dv > 250, false)
          OR coalesce(dk > 95, false) OR coalesce(state = 'error' AND value > 200, false) AS global_label
        FROM (SELECT *, abs(value - lag(value) OVER (ORDER BY ts_us, event_id)) AS dv,
                abs(k - lag(k) OVER (ORDER BY ts_us, event_id)) AS dk FROM ev)),
      a AS (SELECT value > 150 AS stored, global_label, is_anomaly AS grouped_label,
          r1 OR r2 OR r5 OR ((r3 OR r4) AND state IN ('purchase','error')) AS restricted_label
        FROM lab JOIN g USING (event_id))
      SELECT count(*) AS total, count(*) FILTER (WHERE stored) AS stored_anomaly,
        count(*) FILTER (WHERE global_label) AS global_anomaly,
        count(*) FILTER (WHERE global_label <> stored) AS stored_vs_global_mismatch,
        count(*) FILTER (WHERE grouped_label) AS grouped_anomaly,
        count(*) FILTER (WHERE grouped_label <> stored) AS stored_vs_grouped_mismatch,
        count(*) FILTER (WHERE restricted_label) AS restricted_anomaly,
        count(*) FILTER (WHERE restricted_label <> stored) AS stored_vs_restricted_mismatch,
        count(*) FILTER (WHERE global_label <> grouped_label) AS global_vs_grouped_mismatch,
        count(*) FILTER (WHERE grouped_label <> restricted_label) AS grouped_vs_restricted_mismatch
      FROM a""",
)
def d25(spark, folder):
    names = ["global_label", "grouped_label", "restricted_label"]
    keep = ["event_id", "ts_us", "user_id", "state", "value", "k"]
    df = ev.events(spark, folder)
    whole = add_labels(add_steps(df, [], ev.ORDER, ev.CHANNELS), ev.RULES)
    df = whole.select(*keep, F.col("is_anomaly").alias(names[0]))
    stepped = add_steps(df, [ev.GROUP], ev.ORDER, ev.CHANNELS)
    grouped = add_labels(stepped, ev.RULES).withColumnRenamed("is_anomaly", names[1])
    narrow = add_labels(grouped, restricted(ev.RULES, ev.STATES))
    audited = narrow.withColumnRenamed("is_anomaly", names[2]).withColumn(
        "stored", F.col("value") > 150
    )
    return pf.label_audit(
        audited, "stored", {"global": names[0], "grouped": names[1], "restricted": names[2]}
    )


@query(
    "d27_missing_counts",
    LAB + """SELECT f.field, count(*) FILTER (WHERE f.missing) AS missing FROM lab,
        LATERAL (VALUES ('value', value IS NULL), ('previous_value', previous_value IS NULL),
          ('k_diff', k_diff IS NULL)) f(field, missing) GROUP BY f.field""",
)
def d27(spark, folder):
    return pf.missing_counts(
        ev.labelled_events(spark, folder), ["value", "previous_value", "k_diff"]
    )


@query(
    "d28_run_log_summary",
    """SELECT event_type AS state, count(*) AS runs, round(avg(value), 6) AS mean,
      round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max,
      round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95
      FROM events GROUP BY event_type""",
)
def d28(spark, folder):
    out = pf.run_log_summary(ev.events(spark, folder), ["state"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "median", "p95")})


@query(
    "d29_length_summary",
    """SELECT lang, min(length(text))::DOUBLE AS min, max(length(text))::DOUBLE AS max,
      round(avg(length(text)), 6) AS mean, count(*) FILTER (WHERE length(text) > 4000) AS truncated,
      round(quantile_cont(length(text), 0.95), 6) AS p95,
      round(quantile_cont(length(text), 0.99), 6) AS p99 FROM documents GROUP BY lang""",
)
def d29(spark, folder):
    df = ev.table(spark, folder, "documents")
    out = pf.length_summary(df, "text", ["lang"], 4000)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p95", "p99")})


def sequences(spark, folder):
    """Eight-step sequences of state flags and channels."""
    flags = one_hot(F.col("state"), ev.STATES, "state")
    step = F.array(
        *flags.values(), F.coalesce("value", F.lit(0.0)), F.coalesce("k", F.lit(0.0))
    )
    df = ev.with_buckets(ev.events(spark, folder))
    return rolling_sequence(df, [ev.GROUP], ev.ORDER, step, 8)


_STEPS = LAB + """, s AS (SELECT event_id, split, list({v: value, k: coalesce(k, 0), st: state})
        OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
        AS q FROM lab),
      padded AS (SELECT event_id, split, unnest(range(1, 9)) AS i, q FROM s),
      st AS (SELECT event_id, split, i,
          CASE WHEN i <= 8 - len(q) THEN q[1] ELSE q[i - 8 + len(q)] END AS e FROM padded),
      fv AS (SELECT event_id, split, i, f.feature, f.x FROM st, LATERAL (VALUES
          ('state_purchase', (e.st = 'purchase')::INT::DOUBLE),
          ('state_error', (e.st = 'error')::INT::DOUBLE),
          ('state_other', (e.st NOT IN ('purchase', 'error'))::INT::DOUBLE),
          ('value', e.v), ('k', e.k)) f(feature, x)),
      stats AS (SELECT feature, avg(x) AS mean,
          CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS std
        FROM fv WHERE split = 'train' GROUP BY feature)
"""


@query(
    "d30_sequence_statistics",
    _STEPS + "SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM stats",
)
def d30(spark, folder):
    train = sequences(spark, folder).filter("split = 'train'")
    out = pf.feature_statistics(train, "sequence", STEP_FEATURES)
    return out.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "d30_sequence_normalised",
    _STEPS + """SELECT event_id, round(sum((x - mean) / std * i), 4) AS weighted
      FROM fv JOIN stats USING (feature) GROUP BY event_id""",
)
def d30_apply(spark, folder):
    df = sequences(spark, folder)
    stats = pf.feature_statistics(df.filter("split = 'train'"), "sequence", STEP_FEATURES)
    scaled = pf.normalised(df, "sequence", stats, STEP_FEATURES, "scaled")
    weighted = F.aggregate(
        F.transform(
            "scaled",
            lambda s, i: F.aggregate(s, F.lit(0.0), lambda a, b: a + b) * (i + 1),
        ),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    return scaled.select("event_id", F.round(weighted, 4).alias("weighted"))


@query(
    "d32_anomaly_rate",
    LAB + """SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalies,
      round(100 * count(*) FILTER (WHERE is_anomaly) / count(*), 9) AS anomaly_percent FROM lab""",
)
def d32(spark, folder):
    out = pf.anomaly_rate(ev.labelled_events(spark, folder), "is_anomaly")
    return out.withColumn("anomaly_percent", F.round("anomaly_percent", 9))
