"""Published values: boundary suites, metrics, intervals and paired tests."""

import pytest
from pyspark.sql import functions as F

from stepguard.functions.text import fixed
from stepguard.operators import evaluate as ea
from stepguard.operators import profile as pf
from stepguard.operators.rules import (
    label_variants,
    leave_one_out,
    state_bucket,
    variants_long,
)
from stepguard.operators.sampling import key_multiplicity, keep_one
from stepguard.operators.splits import set_overlap
from stepguard.plans import cycler as cy
from stepguard.plans.verification import near_threshold_report, verifier_report

# The cases (counted from 900000) that each published model called positive.
POSITIVE_CASES = {
    "base": "2 3 4 6 7 8 9 10 11 12 13 18 19 20 21 26 27 28 29 34 35 36 37 40 45 58 59 60",
    "pure": "3 4 6 7 10 11 18 19 20 21 26 27 28 29 34 35 36 37 40 41 42 45 46 47 50 51 52",
    "weighted": "2 3 4 6 7 9 10 11 13 18 19 20 21 26 27 28 29 34 35 36 37",
}
METHODS = list(POSITIVE_CASES)


@pytest.fixture(scope="module")
def suite(spark):
    return cy.boundary_tests(spark).cache()


@pytest.fixture(scope="module")
def predictions(suite):
    """Published verdicts on the suite; the score is one for a positive verdict."""
    entries = []
    for method, cases in POSITIVE_CASES.items():
        called = F.col("record_id").isin([cy.TEST_FIRST_ID + int(c) for c in cases.split()])
        entries.append(F.struct(F.lit(method).alias("method"), called.alias("pred")))
    long = suite.select("record_id", "case_type", "gold", F.inline(F.array(*entries)))
    return long.withColumn("anomaly_score", F.col("pred").cast("double")).cache()


def test_suite_shape(suite):
    assert suite.count() == 71 and suite.filter("gold").count() == 21
    ids = suite.agg(F.min("record_id"), F.max("record_id"), F.countDistinct("record_id")).first()
    assert tuple(ids) == (900000, 900070, 71)
    buckets = suite.groupBy(
        state_bucket(F.col("state"), cy.STATE_NAMES, cy.OTHER_STATE).alias("b")
    ).count()
    assert {r["b"]: r["count"] for r in buckets.collect()} == {
        "charge": 26, "discharge": 24, "other_or_idle": 21,
    }


def test_rule_removal(suite):
    variants = label_variants(cy.RULES, cy.REMOVALS)
    rows = suite.withColumn("split", F.lit("boundary"))
    out = pf.sensitivity(rows, variants, "original_all_rules", "split", ["boundary"])
    got = {r["variant"]: r["positive_labels"] for r in out.filter("split = 'boundary'").collect()}
    assert list(got[name] for name in cy.REMOVALS) == [21, 19, 12, 19, 17]


def test_leave_one_out_covers_the_fixed_variants():
    ours = leave_one_out(cy.RULES)
    assert len(ours) == 6
    assert all(ours[n] == r for n, r in cy.REMOVALS.items() if n in ours)


def test_suite_features_keep_the_stored_differences(suite):
    rows = {r["record_id"]: r for r in cy.boundary_features(suite).collect()}
    cases = {r["record_id"]: r for r in suite.collect()}
    assert len(rows) == 71
    for record_id, case in cases.items():
        vector = rows[record_id]["features"]
        assert len(vector) == 16 and vector[15] == 1.0
        assert vector[:3] == [float(case["state"] == s) for s in (110, 30, 0)]
        assert [vector[i] for i in (5, 8, 11, 14)] == [case[f"{c}_diff"] for c in cy.CHANNELS]
        assert vector[3] == pytest.approx(case["total_voltage"], abs=5e-5)
    just_below = 3.8 + 0.05 - 3.8
    assert just_below < 0.05 and any(r["features"][8] == just_below for r in rows.values())


def test_distribution_of_the_suite(suite):
    out = pf.distribution(suite, ["total_voltage", "cell_voltage_diff", "temperature_diff"])
    got = {r["feature"]: r for r in out.collect()}
    total = got["total_voltage"]
    assert [total[c] for c in ("n", "min", "median", "p95", "p99", "max")] == pytest.approx(
        [71, 3.8, 3.849, 378.201, 378.21, 378.21]
    )
    assert total["mean"] == pytest.approx(89.2023338028169, abs=1e-9)
    assert total["std"] == pytest.approx(147.72695747561048, abs=1e-9)
    assert got["temperature_diff"]["std"] == pytest.approx(1.2246268718280409, abs=1e-9)


def test_correlation_of_the_suite(suite):
    out = pf.pearson(suite, ["total_voltage", "total_voltage_diff", "cell_voltage"])
    got = {(r["row_feature"], r["column_feature"]): r["pearson_r"] for r in out.collect()}
    assert got["total_voltage", "total_voltage_diff"] == pytest.approx(0.5454244764485706, abs=1e-9)
    assert got["total_voltage", "cell_voltage"] == pytest.approx(-0.4024128712757627, abs=1e-9)


def test_training_grid(spark, suite):
    train = cy.boundary_training(spark).cache()
    assert train.count() == 1017
    keyed = train.withColumn("key", cy.scenario_key(F.col("messages"), F.col("case_type")))
    check = key_multiplicity(keyed, "key", 3).first()
    assert check["distinct_keys"] == 339 and check["unexpected_keys"] == 0
    assert keep_one(keyed, ["key"], "record_id").count() == 339
    signature = cy.question_signature(F.col("messages")).alias("s")
    assert set_overlap(train.select(signature), suite.select(signature)).first()["shared"] == 0
    families = {r["case_type"]: r["count"] // 3 for r in train.groupBy("case_type").count().collect()}
    assert sorted(families.values()) == sorted([48, 36, 120, 81, 24, 16, 6, 8])
    text = train.filter("record_id = 911016").select(F.element_at("messages", 2)["content"]).first()[0]
    assert "记录号：911016\n" in text


def test_confusion_and_ranking(predictions):
    cells = {r["method"]: r for r in ea.metrics(predictions, ["method"], "gold", "pred").collect()}
    got = {m: tuple(cells[m][c] for c in ("tp", "fp", "tn", "fn")) for m in METHODS}
    assert got == {"base": (11, 17, 33, 10), "pure": (17, 10, 40, 4), "weighted": (11, 10, 40, 10)}
    assert cells["base"]["accuracy"] == pytest.approx(0.6197183098591549, abs=1e-12)
    curve = ea.score_curve(predictions, ["method"], "gold", "anomaly_score", segment_rows=9)
    ranks = {r["method"]: r for r in ea.ranking_metrics(curve, ["method"]).collect()}
    for m in METHODS:
        # With two scores the area is the mean of recall and specificity.
        area = (cells[m]["recall"] + cells[m]["specificity"]) / 2
        assert ranks[m]["auroc"] == pytest.approx(area, abs=1e-12)


def test_exact_intervals(spark):
    rows = [(44, 71), (57, 71), (51, 71), (12, 12), (20, 20), (30, 31), (0, 5), (0, 0)]
    df = spark.createDataFrame(rows, "correct bigint, total bigint")
    out = ea.with_exact_interval(df, F.col("correct"), F.col("total")).collect()
    got = {
        (r["correct"], r["total"]): (r["accuracy_exact_ci_lower"], r["accuracy_exact_ci_upper"])
        for r in out
    }
    assert got[44, 71] == pytest.approx((0.49672070003447977, 0.7323964405062462), abs=1e-9)
    assert got[57, 71] == pytest.approx((0.6913500428435166, 0.8877921791544382), abs=1e-9)
    assert got[51, 71] == pytest.approx((0.5990036291511959, 0.8186961621308975), abs=1e-9)
    assert got[12, 12] == pytest.approx((0.7353515306029488, 1.0), abs=1e-9)
    assert got[20, 20] == pytest.approx((0.8315665290169146, 1.0), abs=1e-9)
    assert got[30, 31] == pytest.approx((0.8329788837697722, 0.9991836299281533), abs=1e-9)
    assert got[0, 5][0] == 0.0 and got[0, 0] == (None, None)


def test_paired_tests_and_step_down(predictions):
    patterns = ea.verdict_patterns(predictions, [], "record_id", "method", "gold", "pred", METHODS)
    assert patterns.count() <= 8
    tests = ea.add_mcnemar(ea.paired_counts(patterns, [], METHODS)).withColumn("f", F.lit("x"))
    out = {(r["first"], r["second"]): r for r in ea.holm(tests, ["f"], "exact_two_sided_p", ["first"]).collect()}
    wanted = {
        ("base", "pure"): (1, 14, 0.0009765625, 0.0029296875),
        ("base", "weighted"): (0, 7, 0.015625, 0.03125),
        ("pure", "weighted"): (9, 3, 0.14599609375, 0.14599609375),
    }
    for pair, (a, b, p, adjusted) in wanted.items():
        row = out[pair]
        assert (row["first_correct_second_wrong"], row["first_wrong_second_correct"]) == (a, b)
        assert row["exact_two_sided_p"] == pytest.approx(p, rel=1e-9)
        assert row["holm_adjusted_p"] == pytest.approx(adjusted, rel=1e-9)


def test_extreme_paired_counts(spark):
    rows = [(97, 0), (26, 0), (0, 0), (5, 5)]
    df = spark.createDataFrame(
        rows, "first_correct_second_wrong bigint, first_wrong_second_correct bigint"
    )
    got = [r["exact_two_sided_p"] for r in ea.add_mcnemar(df).collect()]
    assert got == pytest.approx([1.262177448353619e-29, 2.9802322387695312e-08, 1.0, 1.0], rel=1e-9)


def test_rescoring(suite, predictions):
    labels = variants_long(suite, label_variants(cy.RULES, cy.REMOVALS), ["record_id"])
    out = ea.rescored(predictions, labels, "record_id", ["method"], "pred")
    row = out.filter("method = 'base' and variant = 'remove_cell_voltage_jump'").first()
    assert [row[c] for c in ("tp", "fp", "tn", "fn")] == [2, 26, 33, 10]
    row = out.filter("method = 'base' and variant = 'remove_charge_total_jump'").first()
    assert row["f1"] == pytest.approx(0.46808510638297873, abs=1e-12) and row["positive"] == 19


def test_verifier_corrections(suite, predictions):
    # Texts show 0.0500 for a difference just below 0.05, and both are not above it.
    references = suite.select(
        F.lit("boundary").alias("dataset"),
        "record_id",
        "gold",
        F.element_at("messages", 2)["content"].alias("text"),
    )
    report = verifier_report(references, predictions.withColumn("dataset", F.lit("boundary")))
    got = {r["method"]: r for r in report.comparison.collect()}
    assert {m: got[m]["corrected_model_errors"] for m in METHODS} == {
        "base": 27, "pure": 14, "weighted": 20,
    }
    assert all(r["unnecessary_overrides"] == 0 and r["final_accuracy"] == 1.0 for r in got.values())
    assert report.inconsistent.count() == 61
    assert report.missing.agg(F.sum("missing")).first()[0] == 0


def test_near_threshold_report(suite, predictions):
    rules = [r for r in cy.RULES if r.name in ("charge_current_jump", "cell_voltage_jump")]
    report = near_threshold_report(suite, predictions, rules, METHODS)
    manifest = {(r["rule"], r["scope"]): r["samples"] for r in report.manifest.collect()}
    assert manifest["charge_current_jump", "all"] == manifest["charge_current_jump", "isolated"] == 5
    assert report.sides.count() == 3 * 2 * 2 * 2
    assert report.paired.count() == 2 * 2 * 3
    assert report.overrides.agg(F.sum("unnecessary_overrides")).first()[0] == 0
    metric = report.metrics.filter("method = 'base' and rule = 'cell_voltage_jump' and scope = 'all'").first()
    assert metric["samples"] == metric["tp"] + metric["fp"] + metric["tn"] + metric["fn"]


def test_case_table(predictions):
    out = ea.case_table(
        predictions, "record_id", ["case_type", "gold"], "method", METHODS, ["pred", "anomaly_score"]
    )
    assert out.count() == 71
    row = out.filter("record_id = 900002").first()
    assert (row["base_pred"], row["pure_pred"], row["weighted_pred"]) == (True, False, True)


def test_fixed_point_text_rounds_like_c(spark):
    values = [2.00005, 0.05, 3.8 + 0.05 - 3.8, 5e-05, -5e-05, 0.125, 1e-9, -1e-9, 378.2, 123456.78905]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(fixed(F.col("v"), 4)).collect()]
    assert got == [f"{v:.4f}" for v in values]
