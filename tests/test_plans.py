"""End-to-end plans on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stepguard.operators import sampling as sa
from stepguard.operators import splits as sp
from stepguard.operators.forests import fit_isolation_forest, score_isolation_forest, tree_samples
from stepguard.plans import cycler as cy
from stepguard.plans.dataset import boundary_mixes, build_dataset
from stepguard.plans.legacy import instruction_samples, labelled_table
from stepguard.sources.readers import read_jsonl

RAW_SCHEMA = (
    "record_id bigint, cycle_no string, ts string, step_status string, `整车State状态（状态机编码）` string, "
    "`动力电池内部总电压V1` string, `1号电池单体电压` string, `动力电池充/放电电流` string, `1号温度检测点温度` string"
)


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(3)
    rows, voltage = [], 3.8
    for i in range(4000):
        cycle = i // 50
        state = rng.choice(["110", "30", "0", "110.0", ""])
        voltage = 3.8 + rng.random() * (0.2 if rng.random() < 0.06 else 0.04)
        current = "" if rng.random() < 0.02 else f"{10 + rng.random() * 0.4:.3f}"
        rows.append(
            (i, str(cycle), f"2024-01-01 {i:06d}", "x", state, f"{voltage:.4f}", f"{voltage:.4f}", current, "25.0")
        )
    return spark.createDataFrame(rows, RAW_SCHEMA)


def brute_labels(rows):
    """Label per record, straight from the rule list."""
    def number(text):
        try:
            return float(text)
        except ValueError:
            return None

    out, before = {}, {}
    for r in sorted(rows, key=lambda r: r["record_id"]):
        state = number(r["整车State状态（状态机编码）"])
        now = {
            "t": number(r["动力电池内部总电压V1"]), "c": number(r["1号电池单体电压"]),
            "i": number(r["动力电池充/放电电流"]), "k": number(r["1号温度检测点温度"]),
        }
        old = before.get(r["cycle_no"], {})
        jump = {k: abs(now[k] - old[k]) if now[k] is not None and old.get(k) is not None else None for k in now}
        fired = [
            state == 110 and jump["t"] is not None and jump["t"] > 3.0,
            state == 110 and jump["i"] is not None and jump["i"] > 0.5,
            jump["c"] is not None and jump["c"] > 0.05,
            jump["k"] is not None and jump["k"] > 3.0,
            state == 30 and now["t"] is not None and now["t"] > 378.2,
        ]
        out[r["record_id"]] = any(fired)
        before[r["cycle_no"]] = now
    return out


def test_dataset_build(spark, raw, tmp_path):
    wanted = brute_labels(raw.collect())
    built = build_dataset(cy.records(raw), str(tmp_path / "set"), trials=300)
    got = {r["record_id"]: r["is_anomaly"] for r in built.labelled.collect()}
    assert got == wanted

    stats = {r["split"]: r for r in built.statistics.collect()}
    assert sum(r["total"] for r in stats.values()) == 4000
    assert abs(stats["test"]["total"] / 4000 - 0.15) < 0.03
    owner = {r["cycle_no"]: r["split"] for r in built.design.collect()}
    seen = {}
    for split, path in built.balanced.items():
        rows = [json.loads(r[0]) for r in spark.read.text(path).collect()]
        positives = sum(r["is_anomaly"] for r in rows)
        assert positives * 2 == len(rows) == 2 * stats[split]["anomaly"]
        for r in rows:
            assert owner[r["cycle_no"]] == split and r["record_id"] not in seen
            seen[r["record_id"]] = split
            assert r["messages"][2]["content"].startswith("异常。" if r["is_anomaly"] else "正常。无异常")
    assert spark.read.text(built.natural_test).count() == stats["test"]["total"]
    assert built.manifest.count() >= 4

    # Every text verdict equals the label: four decimals lose nothing here.
    schema = "record_id bigint, is_anomaly boolean, messages array<struct<role string, content string>>"
    natural = read_jsonl(spark, built.natural_test, schema)
    texts = natural.select("record_id", "is_anomaly", F.element_at("messages", 2)["content"].alias("text"))
    checked = cy.verified(texts, "text")
    assert checked.filter("rule_pred <> is_anomaly").count() == 0
    with pytest.raises(Exception, match="already exists"):
        build_dataset(cy.records(raw), str(tmp_path / "set"), trials=10)


def test_first_record_of_a_cycle_has_no_previous(spark, raw):
    first = cy.labelled(cy.records(raw)).filter("record_id % 50 = 0")
    assert first.filter("previous_cell_voltage is not null or cell_voltage_diff is not null").count() == 0
    text = cy.natural_samples(first).select(F.element_at("messages", 2)["content"]).first()[0]
    assert "本循环上一行总电压：缺失 V" in text


@pytest.mark.parametrize("segment_rows", [100, 10**6])
def test_whole_table_labelling_with_several_cells(spark, segment_rows):
    rows = [
        (0, 110.0, 300.0, 3.80, 3.80, 1.0, 25.0),
        (1, 110.0, 303.5, 3.90, 3.81, 1.6, 25.0),
        (2, 30.0, 379.0, 3.90, None, 9.0, 29.0),
        (3, None, 100.0, 3.90, 3.70, 1.0, 29.0),
    ]
    rows += [(i, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(4, 400)]
    schema = (
        f"record_id bigint, `{cy.STATE_COLUMN}` double, `动力电池内部总电压V1` double, `1号电池单体电压` double, "
        "`2号电池单体电压` double, `动力电池充/放电电流` double, `1号温度检测点温度` double"
    )
    df = labelled_table(spark.createDataFrame(rows, schema), ["record_id"], segment_rows)
    got = {r["record_id"]: r["anomaly_reasons"] for r in df.filter("record_id < 4").collect()}
    assert got[0] == "无异常"
    assert got[1] == (
        "充电时总电压跳变过大（上一行300.00V→本行303.50V，跳变3.50V > 阈值3.0V）; "
        "1号电池单体电压跳变过大（上一行3.8000V→本行3.9000V，跳变0.1000V > 阈值0.05V）; "
        "充电时电流跳变过大（上一行1.00A→本行1.60A，跳变0.60A > 阈值0.5A）"
    )
    assert got[2] == (
        "放电时总电压超过最大阈值（379.00V > 阈值378.2V）; "
        "温度跳变过大（上一行25.00℃→本行29.00℃，跳变4.00℃ > 阈值3.0℃）"
    )
    assert got[3] == "无异常"
    samples = {r["record_id"]: r for r in instruction_samples(df).filter("record_id < '4'").collect()}
    assert samples["2"]["output"].startswith("异常。放电时")
    assert "2号电池单体电压" not in samples["2"]["instruction"].split("\n", 1)[1]
    assert "1号温度检测点温度：29.0" in samples["2"]["instruction"]


def test_chronological_cut_against_brute_force(spark):
    rng = random.Random(11)
    for case in range(3):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(3, 40))]
        rows = [(f"g{i}", i * 100, n) for i, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "g string, first_id bigint, total bigint")
        out = sp.chronological_split(df, "first_id", "total", segment_rows=7 if case else 10**6)
        got = [r["split"] for r in out.orderBy("first_id").collect()]

        def cut(target, start):
            best, place, total = abs(sum(sizes[:start]) - target), start, sum(sizes[:start])
            for i in range(start, len(sizes)):
                total += sizes[i]
                if abs(total - target) > best:
                    break
                best, place = abs(total - target), i + 1
            return place

        train = cut(round(sum(sizes) * 0.70), 0)
        val = cut(round(sum(sizes) * 0.85), train)
        wanted = ["train"] * train + ["val"] * (val - train) + ["test"] * (len(sizes) - val)
        assert got == wanted


def test_unknown_group_stops_the_lookup(spark):
    df = spark.createDataFrame([("a",), ("b",)], "g string")
    design = spark.createDataFrame([("a", "train")], "g string, split string")
    assert sp.with_split(df.filter("g = 'a'"), design, "g").first()["split"] == "train"
    with pytest.raises(Exception, match="absent from split design: b"):
        sp.with_split(df, design, "g").collect()


def test_isolation_forest_finds_far_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(600)]
    rows += [(1000 + i, [8.0 + i, -9.0 - i]) for i in range(6)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>")
    samples = tree_samples(df, "id", "x", 60, 128, 1)
    sizes = {r["tree"]: r["count"] for r in samples.groupBy("tree").count().collect()}
    assert len(sizes) == 60 and max(sizes.values()) == 128 and min(sizes.values()) > 100
    nodes = fit_isolation_forest(df, "id", "x", 60, 128, 1)
    scored = score_isolation_forest(df, nodes, "x").orderBy(F.desc("score")).limit(6)
    assert {r["id"] for r in scored.collect()} == {1000 + i for i in range(6)}


def test_large_tables_are_thinned_before_the_shuffle(spark):
    df = spark.range(200_000).select("id", F.array(F.rand(1)).alias("x"))
    samples = tree_samples(df, "id", "x", 10, 64, 3)
    sizes = [r["count"] for r in samples.groupBy("tree").count().collect()]
    assert len(sizes) == 10 and min(sizes) > 32


def test_boundary_mixes(spark, raw):
    natural = cy.natural_samples(cy.labelled(cy.records(raw))).select(
        "messages", "is_anomaly", "record_id", "cycle_no", "rule_triggers"
    ).withColumn("split", F.lit("train"))
    boundary, tests = cy.boundary_training(spark), cy.boundary_tests(spark)
    mixes = boundary_mixes(natural, boundary, tests)
    label = cy.answer_label(F.col("messages"))
    got = {n: sa.training_summary(m, label).first() for n, m in mixes.items()}
    assert got["pure_augmentation"]["synthetic_boundary"] == 1017
    assert got["boundary_weighted"]["synthetic_boundary"] == 339
    assert got["pure_augmentation"]["weight_sum"] == got["boundary_weighted"]["weight_sum"] == 5017
    for mix in mixes.values():
        assert mix.filter(label != F.col("is_anomaly")).count() == 0
    with pytest.raises(ValueError, match="do not occur 3 times"):
        boundary_mixes(natural, boundary.filter("record_id <> 910000"), tests)
    with pytest.raises(ValueError, match="are test questions"):
        again = tests.select("record_id", "case_type", "gold", "messages")
        boundary_mixes(natural, again, tests, copies=1)


def test_few_shot_messages(spark, raw):
    samples = cy.natural_samples(cy.labelled(cy.records(raw)))
    examples = cy.demonstrations(samples)
    rows = examples.collect()
    assert sorted(r["is_anomaly"] for r in rows) == [False, False, True, True]
    assert all(len(r["user"].split("\n")) == 14 for r in rows)
    out = cy.few_shot_messages(samples, examples).select("messages").first()["messages"]
    assert [m["role"] for m in out] == ["system", *["user", "assistant"] * 4, "user"]
    ordered = sorted(rows, key=lambda r: (r["is_anomaly"], r["selection_key"]))
    random.Random(42).shuffle(ordered)
    assert [m["content"] for m in out[2:9:2]] == [r["assistant"] for r in ordered]
