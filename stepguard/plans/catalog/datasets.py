"""Splits, samples and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepguard.functions.hashing import seeded_integer, seeded_key
from stepguard.functions.numbers import group_key
from stepguard.operators import profile as pf
from stepguard.operators import sampling as sa
from stepguard.operators import splits as sp
from stepguard.operators.adjacent import add_differences
from stepguard.operators.align import positions
from stepguard.operators.boundary import near_threshold_cases
from stepguard.operators.evaluate import accuracy_table
from stepguard.operators.rules import add_labels
from stepguard.plans import events as ev
from stepguard.plans.catalog.evaluation import verdicts
from stepguard.plans.catalog.registry import LAB, PRED, query
from stepguard.session import checkpointed, scratch_path
from stepguard.sources.readers import read_split_design
from stepguard.sources.writers import stack

SEED = 42
SHARES = {"train": 0.7, "val": 0.2, "test": 0.1}
TRIALS = 60_000

# Row split inside each label, by rank of the seeded key.
_ROWSPLIT = LAB + """, rk AS (SELECT event_id, user_id, state, is_anomaly, ts_us,
        row_number() OVER (PARTITION BY is_anomaly ORDER BY sha256('42:' || event_id)) AS place,
        count(*) OVER (PARTITION BY is_anomaly) AS n FROM lab),
      cutted AS (SELECT *, CASE WHEN place <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
          WHEN place <= round_even(n * 0.9::DOUBLE, 0) THEN 'val' ELSE 'test' END AS part FROM rk)
"""


def row_split(spark, folder):
    df = checkpointed(
        ev.labelled_events(spark, folder)
        .drop("split")
        .select("event_id", "user_id", "state", "ts_us", "is_anomaly")
    )
    return sa.stratified_row_split(df, "is_anomaly", "event_id", SHARES, SEED)


@query("f07_stratified_row_split", _ROWSPLIT + "SELECT event_id, part AS split FROM cutted")
def f07(spark, folder):
    return row_split(spark, folder).select("event_id", "split")


@query(
    "c08_adjacent_pairs",
    _ROWSPLIT + """, sel AS (SELECT * FROM cutted WHERE part <> 'val')
      SELECT a.part AS left_split, b.part AS right_split, count(*) AS pairs
      FROM sel a JOIN sel b ON b.event_id = a.event_id + 1 GROUP BY ALL""",
)
def c08(spark, folder):
    return sp.adjacent_pairs(row_split(spark, folder).filter("split <> 'val'"), "event_id", "split")


@query(
    "c08_cross_split_rate",
    _ROWSPLIT + """SELECT count(*) AS adjacent_pairs,
        count(*) FILTER (WHERE a.part <> b.part) AS cross_split_pairs,
        round(count(*) FILTER (WHERE a.part <> b.part) / count(*), 9) AS cross_split_rate
      FROM cutted a JOIN cutted b ON b.event_id = a.event_id + 1""",
)
def c08_rate(spark, folder):
    pairs = sp.adjacent_pairs(row_split(spark, folder), "event_id", "split")
    out = sp.cross_split_rate(pairs)
    return out.withColumn("cross_split_rate", F.round("cross_split_rate", 9))


_CHRONO = LAB + """, g AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomaly,
        min(event_id) AS first_id FROM lab GROUP BY user_id),
      cm AS (SELECT *, sum(total) OVER (ORDER BY first_id) AS cumulative FROM g),
      t AS (SELECT round_even(sum(total) * 0.7::DOUBLE, 0) AS t1,
        round_even(sum(total) * 0.85::DOUBLE, 0) AS t2 FROM g),
      c1 AS (SELECT c AS cut1 FROM (SELECT cumulative AS c FROM cm UNION SELECT 0), t
        ORDER BY abs(c - t1), c DESC LIMIT 1),
      c2 AS (SELECT c AS cut2 FROM (SELECT cumulative AS c FROM cm), t, c1 WHERE c >= cut1
        ORDER BY abs(c - t2), c DESC LIMIT 1)
"""


@query(
    "c09_chronological_split",
    _CHRONO + """SELECT user_id, total, cumulative::BIGINT AS cumulative,
        CASE WHEN cumulative <= cut1 THEN 'train' WHEN cumulative <= cut2 THEN 'val' ELSE 'test' END
        AS split FROM cm, c1, c2""",
)
def c09(spark, folder):
    df = ev.labelled_events(spark, folder)
    profiles = checkpointed(pf.group_profile(df, "user_id", "event_id", "ts_us", "is_anomaly"))
    out = sp.chronological_split(profiles, "first_record_id", "total")
    return out.select("user_id", "total", "cumulative", "split")


@query(
    "a04_split_design",
    _CHRONO + """, sp AS (SELECT user_id, CASE WHEN cumulative <= cut1 THEN 'train'
          WHEN cumulative <= cut2 THEN 'val' ELSE 'test' END AS design FROM cm, c1, c2)
      SELECT design, count(*) AS n, count(*) FILTER (WHERE is_anomaly) AS anomaly
      FROM lab JOIN sp USING (user_id) GROUP BY design""",
)
def a04(spark, folder):
    """The chronological split as design documents, a line per group, read again and joined to the records."""
    df = checkpointed(ev.labelled_events(spark, folder))
    profiles = checkpointed(pf.group_profile(df, "user_id", "event_id", "ts_us", "is_anomaly"))
    split = sp.chronological_split(profiles, "first_record_id", "total")
    line = F.create_map("split", F.array(F.col("user_id").cast("string"))).alias("split_cycles")
    path = scratch_path(spark, "design")
    split.select(line).write.json(path)
    design = read_split_design(spark, path, lines=True).withColumnRenamed("split", "design")
    joined = df.join(design, group_key(F.col("user_id")) == F.col("group"))
    return joined.groupBy("design").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomaly")
    )


@query(
    "c10_lowest_keys_per_label",
    LAB + """SELECT event_id, is_anomaly, sha256('42:' || event_id) AS selection_key FROM lab
      QUALIFY row_number() OVER (PARTITION BY is_anomaly ORDER BY sha256('42:' || event_id)) <= 2""",
)
def c10(spark, folder):
    df = ev.labelled_events(spark, folder).select("event_id", "is_anomaly")
    return sa.lowest_per_label(df, "is_anomaly", "event_id", 2, SEED)


@query(
    "d26_split_ranges",
    _ROWSPLIT + """SELECT part AS split, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomaly,
        count(*) FILTER (WHERE NOT is_anomaly) AS normal, min(event_id) AS min_record_id,
        max(event_id) AS max_record_id, min(ts_us) AS min_timestamp, max(ts_us) AS max_timestamp
      FROM cutted GROUP BY part""",
)
def d26_ranges(spark, folder):
    return sp.split_ranges(row_split(spark, folder), "split", "is_anomaly", "event_id", "ts_us")


@query(
    "d26_status_by_split",
    _ROWSPLIT + "SELECT part AS split, state, count(*) AS n FROM cutted GROUP BY ALL",
)
def d26_status(spark, folder):
    return row_split(spark, folder).groupBy("split", "state").agg(F.count(F.lit(1)).alias("n"))


_PRESENCE = _ROWSPLIT + """, pres AS (SELECT user_id, count(*) AS total,
        count(*) FILTER (WHERE is_anomaly) AS anomaly,
        list_sort(list(DISTINCT part)) AS held FROM cutted GROUP BY user_id)
"""


@query(
    "d26_leakage_summary",
    _PRESENCE + """SELECT count(*) AS groups, count(*) FILTER (WHERE len(held) >= 2)
        AS groups_in_multiple_splits, count(*) FILTER (WHERE len(held) = 3) AS groups_in_all_splits,
        count(*) FILTER (WHERE anomaly > 0) AS groups_with_anomalies FROM pres""",
)
def d26_summary(spark, folder):
    presence = sp.group_presence(row_split(spark, folder), "user_id", "split", "is_anomaly")
    return sp.leakage_summary(presence)


@query(
    "d26_g05_group_report",
    _PRESENCE + """SELECT row_number() OVER (ORDER BY coalesce(try_cast(user_id::VARCHAR AS BIGINT),
          1000000000), user_id) AS position, user_id::VARCHAR AS user_id, total, anomaly,
        array_to_string(held, '|') AS selected_splits, round(anomaly / total, 9) AS anomaly_rate
      FROM pres""",
)
def d26_groups(spark, folder):
    df = row_split(spark, folder).withColumn("user_id", F.col("user_id").cast("string"))
    presence = sp.group_presence(df, "user_id", "split", "is_anomaly")
    ordered = positions(
        presence.withColumn("rank", sp.natural_order("user_id")), [], ["rank", "user_id"]
    )
    return ordered.orderBy("rank", "user_id").select(
        F.col("position").cast("bigint"),
        "user_id",
        "total",
        "anomaly",
        F.array_join("selected_splits", "|").alias("selected_splits"),
        F.round("anomaly_rate", 9).alias("anomaly_rate"),
    )


@query(
    "e01_group_split_lookup",
    _CHRONO + """, dz AS (SELECT user_id, CASE WHEN cumulative <= cut1 THEN 'train'
          WHEN cumulative <= cut2 THEN 'val' ELSE 'test' END AS part FROM cm, c1, c2)
      SELECT part AS split, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomaly
      FROM lab JOIN dz USING (user_id) GROUP BY part""",
)
def e01(spark, folder):
    df = ev.labelled_events(spark, folder).drop("split")
    profiles = checkpointed(pf.group_profile(df, "user_id", "event_id", "ts_us", "is_anomaly"))
    design = sp.chronological_split(profiles, "first_record_id", "total")
    return sp.with_split(df, design, "user_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomaly")
    )


@query(
    "e04_membership_filter",
    LAB + """SELECT event_id, value FROM ev WHERE user_id IN (SELECT user_id FROM lab WHERE r5)""",
)
def e04(spark, folder):
    df = checkpointed(ev.labelled_events(spark, folder).select("event_id", "user_id", "value", "r5"))
    return df.join(df.filter("r5").select("user_id"), "user_id", "left_semi").select("event_id", "value")


@query(
    "e05_dataset_fan_out",
    LAB + """SELECT dataset, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomaly FROM (
        SELECT is_anomaly, 'natural' AS dataset FROM lab WHERE split = 'test' UNION ALL
        SELECT is_anomaly, 'gated' FROM lab WHERE bucket <> 'other' UNION ALL
        SELECT is_anomaly, 'large' FROM lab WHERE value > 100) GROUP BY dataset""",
)
def e05(spark, folder):
    targets = {
        "natural": F.col("split") == "test",
        "gated": F.col("bucket") != "other",
        "large": F.col("value") > 100,
    }
    return sa.fan_out(ev.labelled_events(spark, folder), targets).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomaly")
    )


@query(
    "e09_split_disjointness",
    _ROWSPLIT + """, h AS (SELECT user_id, list(DISTINCT part) AS held FROM cutted GROUP BY user_id)
      SELECT p.first, p.second, count(*) FILTER (WHERE list_contains(held, p.first)
        AND list_contains(held, p.second)) AS shared
      FROM h, (VALUES ('train','val'), ('train','test'), ('val','test')) p(first, second)
      GROUP BY ALL""",
)
def e09(spark, folder):
    return sp.pairwise_overlap(row_split(spark, folder), "split", "user_id")


@query(
    "e09_subset_check",
    """SELECT count(*) AS missing FROM (SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id))""",
)
def e09_subset(spark, folder):
    documents, labels = (ev.table(spark, folder, t) for t in ("documents", "labels"))
    missing = sp.missing_from(documents.select("doc_id"), labels, ["doc_id"])
    return missing.agg(F.count(F.lit(1)).alias("missing"))


OFFSETS = [-5.0, 0.0, 0.5]

_CASES = LAB + """, base AS (SELECT user_id, arg_max(value, ts_us) AS value, arg_max(k, ts_us) AS k
        FROM ev GROUP BY user_id),
      rl(rule, channel, moves, threshold, gate) AS (VALUES ('r1','value',true,100.0::DOUBLE,'purchase'),
        ('r2','k',true,80.0,'purchase'), ('r3','value',true,250.0,NULL), ('r4','k',true,95.0,NULL),
        ('r5','value',false,200.0,'error')),
      cs AS (SELECT user_id, rule, state, o."offset", threshold,
          rule || CASE WHEN gate IS NULL OR gate = state THEN '_boundary' ELSE '_applicability' END
            AS case_type,
          CASE WHEN channel <> 'value' THEN value WHEN moves THEN value + (threshold + o."offset")
            ELSE threshold + o."offset" END AS value,
          CASE WHEN channel = 'value' AND NOT moves THEN threshold + o."offset" ELSE value END
            AS previous_value,
          CASE WHEN channel = 'k' THEN k + (threshold + o."offset") ELSE k END AS k, k AS previous_k
        FROM base, rl, (VALUES (-5.0::DOUBLE), (0.0), (0.5)) o("offset"),
          (VALUES ('purchase'), ('error'), ('view')) s(state)),
      cd AS (SELECT *, abs(value - previous_value) AS vd, abs(k - previous_k) AS kd FROM cs),
      cl AS (SELECT *, (state = 'purchase' AND vd > 100) OR (state = 'purchase' AND kd > 80)
        OR vd > 250 OR kd > 95 OR (state = 'error' AND value > 200) AS gold FROM cd)
"""


def near_cases(spark, folder):
    """Stress cases around every threshold, started from the last event of each user."""
    last = F.max_by(F.struct("value", "k"), F.struct(*ev.ORDER)).alias("last")
    base = ev.events(spark, folder).groupBy("user_id").agg(last).select("user_id", "last.*")
    cases = near_threshold_cases(
        base, ev.RULES, OFFSETS, ["purchase", "error", "view"], ev.CHANNELS, ["user_id"]
    )
    labelled = add_labels(add_differences(cases, ev.CHANNELS), ev.RULES)
    return labelled.withColumn("gold", F.col("is_anomaly"))


@query(
    "f11_near_threshold_cases",
    _CASES + """SELECT user_id, rule, case_type, state, "offset", round(value, 6) AS value,
        round(k, 6) AS k, gold FROM cl""",
)
def f11(spark, folder):
    return near_cases(spark, folder).select(
        "user_id",
        "rule",
        "case_type",
        "state",
        "offset",
        F.round("value", 6).alias("value"),
        F.round("k", 6).alias("k"),
        "gold",
    )


@query(
    "f01_b29_d24_weighted_training_set",
    _CASES + """, u AS (SELECT 'natural' AS src, 1.0 AS w, is_anomaly, NULL AS case_type FROM lab
          WHERE split = 'train'
        UNION ALL SELECT 'synthetic_boundary', 3.0, gold, case_type FROM cl)
      SELECT case_type, count(*) AS total, count(*) FILTER (WHERE src = 'natural') AS natural,
        count(*) FILTER (WHERE src = 'synthetic_boundary') AS synthetic_boundary,
        count(*) FILTER (WHERE NOT is_anomaly) AS normal,
        count(*) FILTER (WHERE is_anomaly) AS anomaly, sum(w)::DOUBLE AS weight_sum
      FROM u GROUP BY case_type""",
)
def f01(spark, folder):
    natural = ev.labelled_events(spark, folder).filter("split = 'train'").select(
        "event_id", "user_id", "is_anomaly"
    )
    synthetic = near_cases(spark, folder).select(
        F.col("gold").alias("is_anomaly"), "case_type", F.lit(None).cast("bigint").alias("user_id")
    )
    union = sa.weighted_union(natural, synthetic, 3.0)
    return sa.training_summary(union, F.col("is_anomaly"), ["case_type"])


@query(
    "d23_f04_replication",
    """WITH c AS (SELECT sha256(regexp_replace('id:' || (event_id + i * (SELECT max(event_id) + 1 FROM events))
          || ' user:' || user_id, 'id:[0-9]+', 'id:<ID>')) AS key FROM events, range(3) t(i))
      SELECT count(*) AS distinct_keys, sum(n)::BIGINT AS rows, min(n) AS min_copies,
        max(n) AS max_copies, count(*) FILTER (WHERE n <> 3) AS unexpected_keys
      FROM (SELECT key, count(*) AS n FROM c GROUP BY key)""",
)
def d23(spark, folder):
    text = F.concat(F.lit("id:"), F.col("event_id"), F.lit(" user:"), F.col("user_id"))
    df = ev.events(spark, folder).select("event_id", text.alias("prompt"))
    copies = sa.replicated(df, "event_id", 3, sa.beyond(df, "event_id"), "prompt", "id:")
    keyed = copies.withColumn("key", F.sha2(F.regexp_replace("prompt", "id:[0-9]+", "id:<ID>"), 256))
    return sa.key_multiplicity(keyed, "key", 3)


@query(
    "f04_replicated_rows",
    """WITH m AS (SELECT max(event_id) + 1 AS step FROM events)
       SELECT event_id + i * step AS event_id, 'id:' || (event_id + i * step) || ' user:' || user_id
       AS prompt FROM events, range(3) t(i), m""",
)
def f04(spark, folder):
    text = F.concat(F.lit("id:"), F.col("event_id"), F.lit(" user:"), F.col("user_id"))
    df = ev.events(spark, folder).select("event_id", text.alias("prompt"))
    return sa.replicated(df, "event_id", 3, sa.beyond(df, "event_id"), "prompt", "id:")


@query(
    "f03_first_per_key",
    """SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source
       FROM documents GROUP BY text""",
)
def f03_first(spark, folder):
    df = ev.table(spark, folder, "documents").select(F.md5("text").alias("key"), "doc_id", "source")
    return sa.keep_one(df, ["key"], "doc_id")


@query(
    "f03_last_per_key",
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS state
       FROM events GROUP BY user_id""",
)
def f03_last(spark, folder):
    df = ev.events(spark, folder).select("user_id", "event_id", "state")
    return sa.keep_one(df, ["user_id"], "event_id", last=True)


@query(
    "f05_balanced_sample",
    LAB + """, c AS (SELECT split, count(*) FILTER (WHERE is_anomaly) AS wanted FROM lab GROUP BY split),
      rk AS (SELECT *, row_number() OVER (PARTITION BY split, is_anomaly
        ORDER BY sha256('42:' || event_id)) AS place FROM lab)
      SELECT event_id, rk.split, is_anomaly FROM rk JOIN c USING (split)
      WHERE is_anomaly OR place <= wanted""",
)
def f05(spark, folder):
    df = checkpointed(
        ev.labelled_events(spark, folder).select("event_id", "split", "is_anomaly")
    )
    return sa.balanced_sample(df, "split", "is_anomaly", "event_id", SEED)


@query(
    "f06_seeded_shuffle",
    """SELECT event_id, row_number() OVER (ORDER BY sha256('42:' || event_id), event_id) AS position
       FROM events""",
)
def f06(spark, folder):
    df = ev.events(spark, folder).select("event_id", seeded_key(SEED, F.col("event_id")).alias("key"))
    placed = positions(df, [], ["key", "event_id"])
    return placed.select("event_id", F.col("position").cast("bigint").alias("position"))


_P = 2147483647


def _mixed(base: str, trial: str) -> str:
    first = f"(({base} + {trial} * 40692) % {_P})"
    second = f"(({first} * {first} + 12345) % {_P})"
    return f"(({second} * {second} + {base}) % {_P})::DOUBLE / {_P}.0"


def _search(pool: str, name: str, share: str) -> str:
    return f"""
      {name}_b AS (SELECT *, ('0x' || substr(sha256('20260725-{name}:' || user_id), 1, 8))::BIGINT % {_P}
        AS base FROM {pool}),
      {name}_s AS (SELECT trial, count(*) AS groups, sum(total) AS t, sum(anomaly) AS a
        FROM {name}_b, range({TRIALS}) r(trial) WHERE {_mixed('base', 'trial')} < {share}
        GROUP BY trial HAVING count(*) >= 2),
      {name}_best AS (SELECT trial FROM {name}_s, target
        ORDER BY 2.0 * abs(t - tt) / tt + 4.0 * abs(a / t - tr) / tr + abs(a - tt * tr) / (tt * tr),
          trial LIMIT 1),
      {name}_in AS (SELECT user_id, {_mixed('base', 'trial')} < {share} AS chosen
        FROM {name}_b, {name}_best)"""


_STRATIFIED = LAB + """, g AS (SELECT user_id, count(*) AS total,
        count(*) FILTER (WHERE is_anomaly) AS anomaly FROM lab GROUP BY user_id),
      target AS (SELECT sum(total) * 0.15::DOUBLE AS tt, sum(anomaly) / sum(total) AS tr FROM g),
""" + _search("g", "test", "0.15::DOUBLE") + """,
      rest AS (SELECT g.* FROM g JOIN test_in USING (user_id) WHERE NOT chosen),
""" + _search("rest", "val", "(0.15::DOUBLE / 0.85::DOUBLE)") + """
      SELECT g.user_id, g.total, CASE WHEN test_in.chosen THEN 'test' WHEN val_in.chosen THEN 'val'
        ELSE 'train' END AS split
      FROM g JOIN test_in USING (user_id) LEFT JOIN val_in USING (user_id)"""


@query("f08_stratified_group_split", _STRATIFIED)
def f08(spark, folder):
    df = ev.labelled_events(spark, folder)
    profiles = checkpointed(pf.group_profile(df, "user_id", "event_id", "ts_us", "is_anomaly"))
    out = sp.stratified_group_split(profiles, "user_id", trials=TRIALS)
    return out.select("user_id", "total", "split")


@query(
    "f12_stacked_metrics",
    PRED + """SELECT method, dataset, 'rules' AS family, count(*) AS samples,
        count(*) FILTER (WHERE pred = gold) AS correct, NULL::BIGINT AS positives FROM pred
        GROUP BY ALL
      UNION ALL SELECT 'none', split, 'labels', count(*), NULL, count(*) FILTER (WHERE is_anomaly)
        FROM lab GROUP BY split""",
)
def f12(spark, folder):
    labelled = checkpointed(ev.labelled_events(spark, folder))
    scored = accuracy_table(verdicts(labelled), ["method", "dataset"], "gold", "pred")
    scored = scored.select("method", "dataset", F.lit("rules").alias("family"), "samples", "correct")
    counts = labelled.groupBy(F.col("split").alias("dataset")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("is_anomaly").alias("positives")
    )
    counts = counts.withColumns({"method": F.lit("none"), "family": F.lit("labels")})
    return stack([scored, counts])


@query(
    "g01_total_order",
    LAB + """SELECT event_id, user_id, is_anomaly FROM lab ORDER BY event_id""",
)
def g01(spark, folder):
    return ev.labelled_events(spark, folder).select("event_id", "user_id", "is_anomaly").orderBy(
        "event_id"
    )


@query(
    "g02_first_anomalies",
    LAB + """SELECT event_id, array_to_string(rule_triggers, '|') AS triggers FROM lab
      WHERE is_anomaly ORDER BY event_id LIMIT 10""",
)
def g02(spark, folder):
    return (
        ev.labelled_events(spark, folder)
        .filter("is_anomaly")
        .orderBy("event_id")
        .limit(10)
        .select("event_id", F.array_join("rule_triggers", "|").alias("triggers"))
    )


@query(
    "g04_best_trial",
    LAB + """, g AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomaly
        FROM lab GROUP BY user_id),
      target AS (SELECT sum(total) * 0.15::DOUBLE AS tt, sum(anomaly) / sum(total) AS tr FROM g),
""" + _search("g", "test", "0.15::DOUBLE") + """
      SELECT trial, groups, t::BIGINT AS total, a::BIGINT AS anomaly FROM test_s
      WHERE trial = (SELECT trial FROM test_best)""",
)
def g04(spark, folder):
    df = ev.labelled_events(spark, folder)
    profiles = checkpointed(pf.group_profile(df, "user_id", "event_id", "ts_us", "is_anomaly"))
    sums = profiles.agg(F.struct(F.sum("total").alias("t"), F.sum("anomaly").alias("a"))).scalar()
    based = profiles.withColumn("base", seeded_integer("20260725-test", F.col("user_id")))
    scores = sp.trial_scores(based, TRIALS, 0.15, sums["t"] * F.lit(0.15), sums["a"] / sums["t"])
    best = F.min_by(F.struct("trial", "groups", "total", "anomaly"), F.struct("score", "trial"))
    return scores.agg(best.alias("best")).select(
        F.col("best.trial").cast("bigint").alias("trial"), "best.groups", "best.total", "best.anomaly"
    )
