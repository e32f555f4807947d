"""Column functions against plain Python on hand-made edge values."""

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepguard.functions import numbers as nu
from stepguard.functions import stats
from stepguard.functions.text import (
    first_labelled,
    first_match,
    fixed,
    identity_key,
    insert_turns,
    keep_lines,
    labelled_number,
    render,
)
from stepguard.functions.verdicts import reconcile, strict_boolean, two_class_score, verdict
from stepguard.operators.align import close
from stepguard.operators.rules import Rule, add_rule_flags, restricted, rules_from_table
from stepguard.operators.splits import natural_order
from stepguard.plans import cycler as cy

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").orderBy("i")


def test_numbers(spark):
    texts = ["", "  ", "abc", None, " 12.5 ", "1e3", "-.5", "NaN", "Infinity", "-inf", "1.5f", "2d", "110.7", "0x10"]
    df = one_column(spark, texts)
    rows = df.select(
        nu.tolerant_number(F.col("c")).alias("t"),
        nu.finite_number(F.col("c")).alias("f"),
        nu.state_code(F.col("c")).alias("s"),
        nu.group_key(F.col("c")).alias("g"),
    ).collect()
    finite = [None, None, None, None, 12.5, 1000.0, -0.5, None, None, None, None, None, 110.7, None]
    assert [r["f"] for r in rows] == finite
    assert [r["s"] for r in rows] == [None if v is None else int(v) for v in finite]
    assert math.isnan(rows[7]["t"]) and rows[8]["t"] == math.inf and rows[9]["t"] == -math.inf
    assert rows[3]["g"] == "missing" and rows[2]["g"] == "abc"


def test_rules_ignore_null_and_nan(spark):
    rule = Rule("r", "x", "level", 3.0, (110,))
    open_rule = Rule("o", "x", "level", 3.0)
    rows = [(110, 3.0), (110, 3.0000001), (30, 9.0), (None, 9.0), (110, None), (110, float("nan")), (110, math.inf)]
    df = spark.createDataFrame(rows, "state int, x double")
    got = add_rule_flags(df, [rule, open_rule]).collect()
    assert [r["r"] for r in got] == [False, True, False, False, False, False, True]
    assert [r["o"] for r in got] == [False, True, True, True, False, False, True]
    narrow = restricted([rule, open_rule], [110, 30])
    assert [r.states for r in narrow] == [(110,), (110, 30)]


def test_rules_from_a_table(spark):
    rows = [("r", "x", "jump", 2.0, ["a"], {"tight": 0.1}, "V"), ("s", "y", "level", 1.0, None, None, None)]
    table = spark.createDataFrame(
        rows,
        "name string, channel string, kind string, threshold double, states array<string>, "
        "windows map<string,double>, unit string",
    )
    assert rules_from_table(table) == [
        Rule("r", "x", "jump", 2.0, ("a",), {"tight": 0.1}, "V"),
        Rule("s", "y", "level", 1.0, None, {}, ""),
    ]


def test_verdict_texts(spark):
    texts = ["异常。x", " 正常。y", "　异常", "判断为异常", "判断为正常", "异常还是正常", "无", None, "x" * 35 + "正常"]
    df = one_column(spark, texts)
    got = df.select(
        verdict(F.col("c"), "异常", "正常", 40, False).alias("a"),
        verdict(F.col("c"), "异常", "正常", 30, True).alias("b"),
    ).collect()
    assert [r["a"] for r in got] == [True, False, True, True, False, True, None, None, False]
    assert [r["b"] for r in got] == [True, False, True, True, False, True, None, None, None]
    both = one_column(spark, ["是正常不是异常"]).select(
        verdict(F.col("c"), "异常", "正常", 40, False).alias("a"),
        verdict(F.col("c"), "异常", "正常", 30, True).alias("b"),
    ).first()
    assert both["a"] is False and both["b"] is None


def test_scores_and_reconciliation(spark):
    df = spark.createDataFrame([(-900.0, 900.0), (900.0, -900.0), (0.0, 0.0)], "a double, n double")
    assert [r[0] for r in df.select(two_class_score(F.col("a"), F.col("n"))).collect()] == [0.0, 1.0, 0.5]
    rows = [(None, True), (True, True), (False, True)]
    df = spark.createDataFrame(rows, "m boolean, r boolean")
    final, kind = reconcile(F.col("m"), F.col("r"))
    got = [tuple(r) for r in df.select(final, kind).collect()]
    assert got == [
        (True, "llm_unparsed_use_rule"), (True, "consistent"), (True, "corrected_by_rule"),
    ]
    with pytest.raises(Exception, match="not a boolean value"):
        one_column(spark, ["yes"]).select(strict_boolean(F.col("c"))).collect()


def test_text_parsing(spark):
    text = "当前总电压：缺失 V\n上一行总电压: 3.5 V\n单体电压：+1.25\n编码：-7.9\n电流：\n 12 A"
    df = one_column(spark, [text])
    c = F.col("c")
    row = df.select(
        labelled_number(c, "当前总电压", "V", "缺失").alias("missing"),
        first_labelled(c, ["当前总电压", "上一行总电压"]).alias("fallback"),
        first_labelled(c, ["单体电压"]).alias("signed"),
        first_labelled(c, ["编码"], r"(-?\d+)", "int").alias("code"),
        first_labelled(c, ["电流"]).alias("next_line"),
        first_match(c, [r"x(\d+)", r"(\d+) A"]).alias("pattern"),
    ).first()
    assert tuple(row) == (None, 3.5, 1.25, -7, 12.0, 12.0)


def test_labelled_numbers_match_a_whole_text_search(spark):
    pieces = ["总电压：", "总电压:", "单体", " ", "\n", "-3.5", "7", "x", "：", " V"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    wanted = []
    for text in texts:
        hits = [re.search(rf"{label}[:：]\s*([-+]?\d+(?:\.\d+)?)", text) for label in ("单体总电压", "总电压")]
        wanted.append(next((float(h.group(1)) for h in hits if h), None))
    df = one_column(spark, texts)
    got = df.select(first_labelled(F.col("c"), ["单体总电压", "总电压"]))
    assert [r[0] for r in got.collect()] == wanted
    assert sum(w is not None for w in wanted) > 100


def test_lines_and_turns(spark):
    df = one_column(spark, [" a:1 \nx\nb:2", "a:1"])
    assert [r[0] for r in df.select(keep_lines(F.col("c"), ["a:", "b:"])).collect()] == ["a:1\nb:2", None]
    turns = F.array(F.lit("d1"), F.lit("d2"))
    messages = F.array(F.lit("s"), F.lit("u"), F.lit("a"))
    row = df.select(insert_turns(messages, turns).alias("x"), insert_turns(messages, None).alias("y")).first()
    assert row["x"] == ["s", "d1", "d2", "u"] and row["y"] == ["s", "u"]


def test_identity_keeps_null_and_blank_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None), ("a", "")], "p string, q string")
    assert df.select(identity_key(F.col("p"), F.col("q"))).distinct().count() == 4


def test_close(spark):
    rows = [(None, None, True), (None, 1.0, False), (1.0, 1.0 + 1e-13, True), (1.0, 1.001, False), (1e15, 1e15 + 1, True)]
    df = spark.createDataFrame(rows, "a double, b double, ok boolean")
    assert df.filter(close(F.col("a"), F.col("b"), 1e-12) != F.col("ok")).count() == 0


def test_natural_order(spark):
    df = one_column(spark, ["10", "2", "x", "1"])
    ordered = df.orderBy(natural_order("c"), "c").collect()
    assert [r["c"] for r in ordered] == ["1", "2", "10", "x"]


@SLOW
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=60), st.integers(0, 6))
def test_fixed_point_matches_printf(spark, values, digits):
    df = one_column(spark, values, "double")
    got = [r[0] for r in df.select(fixed(F.col("c"), digits)).collect()]
    assert got == [f"{v:.{digits}f}" for v in values]


@SLOW
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=40))
def test_parse_undoes_render(spark, numbers):
    values = [n / 10_000 for n in numbers]
    df = one_column(spark, values, "double")
    text = render("当前温度：{v} ℃\n", {"v": fixed(F.col("c"), 4)})
    parsed = df.select(text.alias("t")).select(labelled_number(F.col("t"), "当前温度", "℃", cy.MISSING))
    assert [r[0] for r in parsed.collect()] == pytest.approx(values, abs=1e-12)


def test_incomplete_beta_symmetry():
    import numpy as np

    a, b, x = np.array([0.5, 3.0, 400.0]), np.array([2.0, 7.5, 350.0]), np.array([0.3, 0.2, 0.55])
    left = stats.incomplete_beta(a, b, x)
    right = 1 - stats.incomplete_beta(b, a, 1 - x)
    assert left == pytest.approx(right, abs=1e-13)
    # The uniform case has a closed form.
    assert stats.incomplete_beta(np.array([1.0]), np.array([5.0]), np.array([0.25]))[0] == pytest.approx(1 - 0.75**5)


def test_large_counts_stay_exact():
    low, high = stats.interval_bounds([999_000_000_000], [10**12], 0.05)
    assert low[0] < 0.999 < high[0] and high[0] - low[0] < 1e-6


@pytest.mark.parametrize("n", [10**4, 10**6, 10**9, 10**11, 10**13])
@pytest.mark.parametrize("z", [0.01, 0.1, 1.0, 3.0, 6.0])
def test_p_values_of_large_counts_are_normal(n, z):
    from math import erfc, sqrt

    smaller = int((n - z * sqrt(n)) / 2)
    p = stats.two_sided_p([smaller], [n - smaller])[0]
    # the sum ends half a step beyond the count
    near = erfc((n - 2 * smaller - 1) / sqrt(2 * n))
    assert p == pytest.approx(near, abs=1e-6 if n >= 10**6 else 1e-4)


def test_fraction_and_quadrature_meet():
    import numpy as np

    a = np.array([2999.0, 2990.0, 2950.0, 2000.0])
    b = np.array([4000.0, 90_000.0, 3_000_000.0, 5000.0])
    for shift in (-3.0, -0.5, 0.0, 1.0, 4.0):
        mean = a / (a + b)
        x = mean + shift * np.sqrt(mean * (1 - mean) / (a + b))
        assert stats._quadrature(a, b, x) == pytest.approx(stats.incomplete_beta(a, b, x), abs=1e-10)


def test_few_successes_among_very_many():
    from math import exp

    n = 10**12
    low, high = stats.interval_bounds([0, 5], [n, n], 0.05)
    # the counts are Poisson here
    assert high[0] * n == pytest.approx(3.688879, rel=1e-5)
    assert low[1] * n == pytest.approx(1.623486, rel=1e-5) and high[1] * n == pytest.approx(11.668332, rel=1e-5)
    assert stats.incomplete_beta([1.0], [float(n)], [2.0 / n])[0] == pytest.approx(1 - exp(-2), rel=1e-9)


def test_interval_of_large_counts_is_normal():
    from math import sqrt

    n, k = 10**13, 2 * 10**12
    low, high = stats.interval_bounds([k], [n], 0.05)
    half = 1.959963985 * sqrt(0.2 * 0.8 / n)
    assert low[0] == pytest.approx(0.2 - half, abs=half * 1e-5)
    assert high[0] == pytest.approx(0.2 + half, abs=half * 1e-5)
