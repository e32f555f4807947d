"""Coercion, rules and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepguard.functions.numbers import (
    finite_number,
    group_key,
    one_hot,
    or_zero,
    previous_or_current,
    state_code,
    tolerant_number,
)
from stepguard.functions.verdicts import (
    passes,
    reconcile,
    required_label,
    strict_boolean,
    two_class_score,
)
from stepguard.operators.adjacent import (
    add_previous,
    add_steps,
    channel_jumps,
    jumps_between,
    repeated_previous,
    rolling_sequence,
)
from stepguard.operators.rules import (
    add_labels,
    applies,
    band_members,
    isolated,
    label_variants,
    other_triggers,
    reason_text,
    reasons,
    restricted,
    threshold_side,
    variants_long,
)
from stepguard.operators.splits import first_examples
from stepguard.plans import events as ev
from stepguard.plans.catalog.registry import BAND, LAB, query

REASONS = {
    "r1": "value jump {value} > 100",
    "r2": "k jump {value} > 80",
    "r3": "value jump {value} > 250 ({previous} to {current})",
    "r4": "k jump {value} > 95",
    "r5": "value {value} > 200",
}


def _odd_texts(spark, folder) -> DataFrame:
    """Values as text, with blanks, words and special numbers for some event types."""
    text = (
        F.when(F.col("state") == "view", F.lit(""))
        .when(F.col("state") == "click", F.lit("n/a"))
        .when(F.col("state") == "signup", F.concat(F.lit("  "), F.col("value").cast("string"), F.lit(" ")))
        .when((F.col("state") == "error") & (F.col("value") > 100), F.lit("Infinity"))
        .when((F.col("state") == "error") & (F.col("value") > 50), F.lit("NaN"))
        .otherwise(F.col("value").cast("string"))
    )
    return ev.events(spark, folder).withColumn("txt", text)


_ODD = """
WITH odd AS (SELECT event_id, user_id, event_type AS state,
  CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN 'n/a'
       WHEN event_type = 'signup' THEN '  ' || value || ' '
       WHEN event_type = 'error' AND value > 100 THEN 'Infinity'
       WHEN event_type = 'error' AND value > 50 THEN 'NaN'
       ELSE value::VARCHAR END AS txt FROM events)
"""


@query(
    "b01_tolerant_number",
    _ODD + """SELECT state, count(num) AS parsed, count(*) - count(num) AS nulls,
      round(sum(num) FILTER (WHERE isfinite(num)), 4) AS finite_sum,
      count(*) FILTER (WHERE isinf(num)) AS infinite
    FROM (SELECT *, try_cast(nullif(trim(txt), '') AS DOUBLE) AS num FROM odd) GROUP BY state""",
)
def b01(spark, folder):
    df = _odd_texts(spark, folder).withColumn("num", tolerant_number(F.col("txt")))
    finite = ~F.isnan("num") & (F.abs("num") < float("inf"))
    return df.groupBy("state").agg(
        F.count("num").alias("parsed"),
        F.count_if(F.col("num").isNull()).alias("nulls"),
        F.round(F.sum(F.when(finite, F.col("num"))), 4).alias("finite_sum"),
        F.count_if(F.abs("num") == float("inf")).alias("infinite"),
    )


@query(
    "b02_finite_number",
    _ODD + """SELECT event_id, CASE WHEN isfinite(num) THEN num END AS num
    FROM (SELECT *, try_cast(nullif(trim(txt), '') AS DOUBLE) AS num FROM odd)""",
)
def b02(spark, folder):
    return _odd_texts(spark, folder).select("event_id", finite_number(F.col("txt")).alias("num"))


@query(
    "b03_state_code",
    _ODD + """SELECT code, count(*) AS n FROM (
      SELECT CASE WHEN isfinite(num) THEN CAST(trunc(num) AS INTEGER) END AS code
      FROM (SELECT try_cast(nullif(trim(txt), '') AS DOUBLE) AS num FROM odd)) GROUP BY code""",
)
def b03(spark, folder):
    coded = _odd_texts(spark, folder).select(state_code(F.col("txt")).alias("code"))
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b04_group_key",
    """SELECT coalesce(CAST(CASE WHEN event_type <> 'view' THEN user_id END AS VARCHAR), 'missing')
       AS group_key, count(*) AS n FROM events GROUP BY 1""",
)
def b04(spark, folder):
    user = F.when(F.col("state") != "view", F.col("user_id"))
    keyed = ev.events(spark, folder).select(group_key(user).alias("group_key"))
    return keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))


@query("b05_state_bucket", LAB + "SELECT event_id, bucket FROM lab")
def b05(spark, folder):
    return ev.with_buckets(ev.events(spark, folder)).select("event_id", "bucket")


@query(
    "b06_rule_applicability",
    LAB + """SELECT bucket, count(*) FILTER (WHERE state = 'purchase') AS r1,
      count(*) FILTER (WHERE state = 'purchase') AS r2, count(*) AS r3, count(*) AS r4,
      count(*) FILTER (WHERE state = 'error') AS r5 FROM lab GROUP BY bucket""",
)
def b06(spark, folder):
    df = ev.with_buckets(ev.events(spark, folder))
    return df.groupBy("bucket").agg(
        *[F.count_if(applies(rule, F.col("state"))).alias(rule.name) for rule in ev.RULES]
    )


@query("b07_rule_evaluation", LAB + "SELECT event_id, r1, r2, r3, r4, r5 FROM lab")
def b07(spark, folder):
    return ev.labelled_events(spark, folder).select("event_id", *ev.RULE_NAMES)


@query(
    "b08_restricted_rules",
    LAB + """SELECT event_id, r3 AND state IN ('purchase','error') AS r3,
      r4 AND state IN ('purchase','error') AS r4,
      r1 OR r2 OR r5 OR ((r3 OR r4) AND state IN ('purchase','error')) AS is_anomaly FROM lab""",
)
def b08(spark, folder):
    stepped = add_steps(ev.events(spark, folder), [ev.GROUP], ev.ORDER, ev.CHANNELS)
    rules = restricted(ev.RULES, ev.STATES)
    return add_labels(stepped, rules).select("event_id", "r3", "r4", "is_anomaly")


@query("b09_any_rule_label", LAB + "SELECT event_id, is_anomaly FROM lab")
def b09(spark, folder):
    return ev.labelled_events(spark, folder).select("event_id", "is_anomaly")


@query(
    "b10_trigger_list",
    LAB + "SELECT event_id, array_to_string(rule_triggers, '|') AS rule_triggers FROM lab",
)
def b10(spark, folder):
    return ev.labelled_events(spark, folder).select(
        "event_id", F.array_join("rule_triggers", "|").alias("rule_triggers")
    )


@query(
    "b11_reason_text",
    LAB + """SELECT event_id, CASE WHEN is_anomaly THEN array_to_string(list_filter([
        CASE WHEN r1 THEN 'value jump ' || printf('%.4f', value_diff) || ' > 100' END,
        CASE WHEN r2 THEN 'k jump ' || printf('%.4f', k_diff) || ' > 80' END,
        CASE WHEN r3 THEN 'value jump ' || printf('%.4f', value_diff) || ' > 250 (' ||
             printf('%.4f', previous_value) || ' to ' || printf('%.4f', value) || ')' END,
        CASE WHEN r4 THEN 'k jump ' || printf('%.4f', k_diff) || ' > 95' END,
        CASE WHEN r5 THEN 'value ' || printf('%.4f', value) || ' > 200' END],
        lambda x: x IS NOT NULL), '; ') ELSE 'none' END AS reason FROM lab""",
)
def b11(spark, folder):
    found = reasons(ev.RULES, REASONS, 4)
    return ev.labelled_events(spark, folder).select(
        "event_id", reason_text(found, "; ", "none").alias("reason")
    )


@query(
    "b12_label_variants",
    LAB + """SELECT event_id, v.variant, CASE v.variant
        WHEN 'original_all_rules' THEN is_anomaly WHEN 'remove_r1' THEN r2 OR r3 OR r4 OR r5
        WHEN 'remove_r3' THEN r1 OR r2 OR r4 OR r5 WHEN 'remove_r5' THEN r1 OR r2 OR r3 OR r4
        ELSE r2 OR r3 OR r4 END AS variant_label
      FROM lab, (VALUES ('original_all_rules'), ('remove_r1'), ('remove_r3'), ('remove_r5'),
                        ('remove_r1_r5')) v(variant)""",
)
def b12(spark, folder):
    variants = label_variants(ev.RULES, ev.REMOVALS)
    return variants_long(ev.labelled_events(spark, folder), variants, ["event_id"])


@query(
    "b13_threshold_side",
    LAB + """SELECT event_id, CASE WHEN value_diff <= 100 THEN 'below_or_equal'
      WHEN value_diff > 100 THEN 'above' END AS side FROM lab""",
)
def b13(spark, folder):
    return ev.labelled_events(spark, folder).select(
        "event_id", threshold_side(F.col("value_diff"), 100.0).alias("side")
    )


@query(
    "b14_e06_band_join",
    BAND + """SELECT event_id, rule, window_name, round(feature_value, 6) AS feature_value,
      round(distance, 6) AS distance, side FROM band""",
)
def b14(spark, folder):
    near = band_members(ev.labelled_events(spark, folder), ev.RULES, ["event_id"])
    return near.select(
        "event_id",
        "rule",
        "window_name",
        F.round("feature_value", 6).alias("feature_value"),
        F.round("distance", 6).alias("distance"),
        "side",
    )


@query(
    "b15_isolated_target",
    BAND + """SELECT event_id, rule, list_contains(rule_triggers, rule) AS fired,
      array_to_string(list_filter(rule_triggers, lambda x: x <> rule), '|') AS others,
      len(list_filter(rule_triggers, lambda x: x <> rule)) = 0 AS isolated_target
    FROM band WHERE window_name = 'broad'""",
)
def b15(spark, folder):
    near = band_members(
        ev.labelled_events(spark, folder), ev.RULES, ["event_id", "rule_triggers"]
    ).filter("window_name = 'broad'")
    target, triggers = F.col("rule"), F.col("rule_triggers")
    return near.select(
        "event_id",
        "rule",
        F.array_contains(triggers, target).alias("fired"),
        F.array_join(other_triggers(triggers, target), "|").alias("others"),
        isolated(triggers, target).alias("isolated_target"),
    )


@query(
    "b26_two_class_score",
    LAB + """SELECT event_id, round(1 / (1 + exp(-k/50 + value/100)), 9) AS score,
      1 / (1 + exp(-k/50 + value/100)) >= 0.5 AS pred FROM lab""",
)
def b26(spark, folder):
    score = two_class_score(-F.col("value") / 100, -F.col("k") / 50)
    return ev.events(spark, folder).select(
        "event_id", F.round(score, 9).alias("score"), passes(score, 0.5).alias("pred")
    )


@query(
    "b27_reconciled_verdict",
    LAB + """, m AS (SELECT *, CASE WHEN state <> 'view' THEN value > 150 END AS model FROM lab)
      SELECT event_id, CASE WHEN model IS NULL THEN is_anomaly WHEN model = is_anomaly THEN model
          ELSE is_anomaly END AS final_pred,
        CASE WHEN model IS NULL THEN 'llm_unparsed_use_rule' WHEN model = is_anomaly
          THEN 'consistent' ELSE 'corrected_by_rule' END AS correction_type FROM m""",
)
def b27(spark, folder):
    model = F.when(F.col("state") != "view", F.col("value") > 150)
    final, kind = reconcile(model, F.col("is_anomaly"))
    return ev.labelled_events(spark, folder).select(
        "event_id", final.alias("final_pred"), kind.alias("correction_type")
    )


@query(
    "b28_required_label",
    """SELECT l.doc_id, CASE WHEN quality = 1 THEN toxic = 1 ELSE quality = 0 END AS label,
      toxic = 1 AS from_text FROM labels l""",
)
def b28(spark, folder):
    df = ev.table(spark, folder, "labels")
    stored = F.when(F.col("quality") == 1, F.col("toxic") == 1)
    text = F.when(F.col("toxic") == 1, F.lit(" TRUE ")).otherwise(F.lit("0"))
    return df.select(
        "doc_id",
        required_label(stored, F.col("quality") == 0).alias("label"),
        strict_boolean(text).alias("from_text"),
    )


@query(
    "b30_state_one_hot",
    """SELECT event_id, (event_type = 'purchase')::DOUBLE AS state_purchase,
      (event_type = 'error')::DOUBLE AS state_error,
      (event_type NOT IN ('purchase','error'))::DOUBLE AS state_other FROM events""",
)
def b30(spark, folder):
    flags = one_hot(F.col("state"), ev.STATES, "state")
    return ev.events(spark, folder).select(
        "event_id", *[column.alias(name) for name, column in flags.items()]
    )


@query(
    "b31_imputation",
    LAB + """SELECT event_id, coalesce(value, 0) AS v, coalesce(previous_value, value, 0) AS pv,
      round(coalesce(value_diff, 0), 6) AS dv,
      previous_value IS NOT NULL AND previous_k IS NOT NULL AS has_previous FROM lab""",
)
def b31(spark, folder):
    return ev.labelled_events(spark, folder).select(
        "event_id",
        or_zero(F.col("value")).alias("v"),
        previous_or_current(F.col("previous_value"), F.col("value")).alias("pv"),
        F.round(or_zero(F.col("value_diff")), 6).alias("dv"),
        (F.col("previous_value").isNotNull() & F.col("previous_k").isNotNull()).alias(
            "has_previous"
        ),
    )


@query("c01_previous_row", LAB + "SELECT event_id, previous_value, previous_k FROM lab")
def c01(spark, folder):
    df = add_previous(ev.events(spark, folder), [ev.GROUP], ev.ORDER, ev.CHANNELS)
    return df.select("event_id", "previous_value", "previous_k")


@query(
    "c02_previous_row_whole_table",
    LAB + """SELECT event_id, lag(value) OVER (ORDER BY ts_us, event_id) AS previous_value,
      lag(k) OVER (ORDER BY ts_us, event_id) AS previous_k FROM ev""",
)
def c02(spark, folder):
    df = add_previous(ev.events(spark, folder), [], ev.ORDER, ev.CHANNELS)
    return df.select("event_id", "previous_value", "previous_k")


@query(
    "c03_absolute_difference",
    LAB + """SELECT event_id, round(value_diff, 6) AS value_diff, k_diff FROM lab""",
)
def c03(spark, folder):
    df = add_steps(ev.events(spark, folder), [ev.GROUP], ev.ORDER, ev.CHANNELS)
    return df.select("event_id", F.round("value_diff", 6).alias("value_diff"), "k_diff")


@query(
    "c04_channel_jumps",
    """SELECT vec_id, count(*) FILTER (WHERE jump > 0.25) AS jumps,
      round(max(jump) FILTER (WHERE jump > 0.25), 6) AS largest,
      min(i) FILTER (WHERE jump > 0.25) AS first_channel
    FROM (SELECT vec_id, i, abs(embedding[i]::DOUBLE - before[i]::DOUBLE) AS jump
      FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)
            AS before FROM embeddings), range(1, 65) t(i)) GROUP BY vec_id""",
)
def c04(spark, folder):
    names = [f"c{i:02d}" for i in range(1, 65)]
    vectors = ev.table(spark, folder, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    )
    shifted = add_previous(vectors, ["label"], ["vec_id"], ["embedding"])
    found = shifted.withColumn(
        "jumps", jumps_between("previous_embedding", "embedding", names, 0.25)
    )
    return found.select(
        "vec_id",
        F.size("jumps").cast("bigint").alias("jumps"),
        F.round(F.array_max(F.transform("jumps", lambda j: j["jump"])), 6).alias("largest"),
        F.substring(F.get("jumps", F.lit(0))["channel"], 2, 2).cast("bigint").alias("first_channel"),
    )


@query(
    "c04_wide_channel_jumps",
    LAB + """SELECT event_id, array_to_string(list_filter([
        CASE WHEN value_diff > 60 THEN 'value:' || printf('%.2f', value_diff) END,
        CASE WHEN k_diff > 60 THEN 'k:' || printf('%.2f', k_diff) END],
        lambda x: x IS NOT NULL), ' ') AS jumps FROM lab""",
)
def c04_wide(spark, folder):
    from stepguard.functions.text import fixed

    df = channel_jumps(ev.events(spark, folder), [ev.GROUP], ev.ORDER, ["value", "k"], 60.0)
    shown = F.transform("jumps", lambda j: F.concat(j["channel"], F.lit(":"), fixed(j["jump"], 2)))
    return df.select("event_id", F.array_join(shown, " ").alias("jumps"))


@query(
    "c05_rolling_sequence",
    LAB + """, s AS (SELECT event_id, list(value) OVER (PARTITION BY user_id
        ORDER BY ts_us, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS seq FROM ev)
      SELECT event_id, len(seq) AS filled, seq[1] AS oldest, seq[len(seq)] AS newest,
        round(list_sum(list_transform(range(1, 9), lambda i: i * CASE WHEN i <= 8 - len(seq)
          THEN seq[1] ELSE seq[i - 8 + len(seq)] END)), 4) AS weighted FROM s""",
)
def c05(spark, folder):
    step = F.struct("value", "event_id")
    df = rolling_sequence(ev.events(spark, folder), [ev.GROUP], ev.ORDER, step, 8)
    weighted = F.aggregate(
        F.transform("sequence", lambda x, i: x["value"] * (i + 1)), F.lit(0.0), lambda a, b: a + b
    )
    # the leading pad repeats the first event, so distinct ids are the filled steps
    ids = F.transform("sequence", lambda x: x["event_id"])
    return df.select(
        "event_id",
        F.size(F.array_distinct(ids)).cast("bigint").alias("filled"),
        F.get("sequence", F.lit(0))["value"].alias("oldest"),
        F.get("sequence", F.lit(7))["value"].alias("newest"),
        F.round(weighted, 4).alias("weighted"),
    )


@query(
    "c06_repeated_previous",
    LAB + """SELECT event_id, 8 AS steps, round(28 * coalesce(previous_value, value) + 8 * value, 4)
      AS weighted FROM lab""",
)
def c06(spark, folder):
    df = add_previous(ev.events(spark, folder), [ev.GROUP], ev.ORDER, ["value"])
    before = F.coalesce("previous_value", "value")
    sequence = repeated_previous(before, F.col("value"), 8)
    weighted = F.aggregate(
        F.transform(sequence, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b
    )
    return df.select(
        "event_id", F.size(sequence).alias("steps"), F.round(weighted, 4).alias("weighted")
    )


@query(
    "c07_first_examples",
    BAND + """SELECT rule, window_name, side, event_id FROM band QUALIFY row_number() OVER (
      PARTITION BY rule, window_name, side ORDER BY event_id) <= 5""",
)
def c07(spark, folder):
    near = band_members(ev.labelled_events(spark, folder), ev.RULES, ["event_id"])
    keys = ["rule", "window_name", "side"]
    return first_examples(near, keys, ["event_id"], 5).select(*keys, "event_id")


@query(
    "c07_g02_first_mismatches",
    LAB + """SELECT event_id, user_id, array_to_string(rule_triggers, '|') AS triggers FROM lab
      WHERE (r3 OR r4) AND NOT (r1 OR r2 OR r5) AND state NOT IN ('purchase','error')
      ORDER BY event_id LIMIT 20""",
)
def c07_overall(spark, folder):
    df = ev.labelled_events(spark, folder)
    narrow = [f"n_{n}" for n in ev.RULE_NAMES]
    from stepguard.operators.rules import any_rule, fires

    flags = {
        f"n_{rule.name}": fires(rule, F.col("state")) for rule in restricted(ev.RULES, ev.STATES)
    }
    both = df.withColumns(flags).withColumn("narrow_label", any_rule(narrow))
    return (
        both.filter(F.col("is_anomaly") != F.col("narrow_label"))
        .orderBy("event_id")
        .limit(20)
        .select("event_id", "user_id", F.array_join("rule_triggers", "|").alias("triggers"))
    )
