"""Hot groups: the segmented plans must give what a plain window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stepguard.operators.adjacent import add_previous, rolling_sequence
from stepguard.operators.ordered import exact_quantiles, running_totals
from stepguard.operators.sampling import balanced_sample, cut_keys, stratified_row_split
from stepguard.functions.hashing import seeded_key


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of all rows, many small ones, a null group, tied times."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"g{rng.randrange(200)}")
        time = rng.choice([0, 0, 0, 10**12]) if group == "hot" else rng.randrange(10**6)
        value = None if rng.random() < 0.05 else round(rng.random() * 100, 2)
        rows.append((i, group, time, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, g string, t bigint, v double").repartition(5).cache()


@pytest.mark.parametrize("segment_rows", [7, 50, 400])
@pytest.mark.parametrize("group", [["g"], []])
def test_previous_row(skewed, segment_rows, group):
    plain = Window.partitionBy(*(group or [F.lit(0)])).orderBy("t", "id")
    wanted = skewed.withColumn("previous_v", F.lag("v").over(plain))
    got = add_previous(skewed, group, ["t", "id"], ["v"], segment_rows=segment_rows)
    assert got.columns == wanted.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


@pytest.mark.parametrize("segment_rows", [3, 60])
def test_rolling_sequence_spans_several_segments(skewed, segment_rows):
    plain = rolling_sequence(skewed, ["g"], ["t", "id"], F.col("id"), 8)
    split = rolling_sequence(skewed, ["g"], ["t", "id"], F.col("id"), 8, segment_rows=segment_rows)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


@pytest.mark.parametrize("segment_rows", [10, 300])
@pytest.mark.parametrize("group", [["g"], []])
def test_running_totals(skewed, segment_rows, group):
    one = F.lit(1)
    args = (group, ["t", "id"], {"place": one}, {"size": one})
    plain = running_totals(skewed, *args)
    split = running_totals(skewed, *args, segment_rows=segment_rows)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_segments_bound_the_hot_group(skewed, spark):
    from stepguard.operators import ordered

    rows, edges = ordered._segmented(skewed, ["g"], ["t", "id"], 64)
    sizes = rows.filter("g = 'hot'").groupBy(ordered._SEGMENT).count().collect()
    assert len(sizes) > 8
    assert max(r["count"] for r in sizes) < 4 * 64
    assert edges.count() <= 2 * -(-3000 // 64)


def test_plans_have_no_cross_join(skewed):
    frame = running_totals(skewed, [], ["t", "id"], {"place": F.lit(1)}, segment_rows=100)
    assert "NestedLoop" not in frame._jdf.queryExecution().toString()
    frame = add_previous(skewed, [], ["t", "id"], ["v"], segment_rows=100)
    assert "NestedLoop" not in frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("segment_rows", [16, 10_000])
def test_exact_quantiles(skewed, segment_rows):
    levels = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    got = exact_quantiles(skewed, ["g"], "v", levels, segment_rows)
    wanted = skewed.groupBy("g").agg(
        F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.99))).alias("q")
    )
    left = {r["g"]: [r["p05"], r["p50"], r["p99"]] for r in got.collect()}
    for row in wanted.filter("q is not null").collect():
        assert left[row["g"]] == pytest.approx(row["q"])


def test_cut_keys_select_the_exact_count(spark):
    df = spark.range(5000).select(
        "id", (F.col("id") % 3).alias("s"), seeded_key(1, F.col("id")).alias("key")
    )
    wanted = spark.createDataFrame([(0, 0), (1, 17), (2, 10**6)], "s bigint, wanted bigint")
    cuts = {r["s"]: r["wanted"] for r in cut_keys(df, ["s"], "key", wanted).collect()}
    rows = df.collect()
    chosen = [sum(r["s"] == s and r["key"] <= cuts[s] for r in rows) for s in range(3)]
    assert chosen == [0, 17, sum(r["s"] == 2 for r in rows)]


def test_balanced_sample_is_balanced_per_split(spark):
    df = spark.range(4000).select(
        F.col("id"),
        F.when(F.col("id") % 5 < 3, "train").otherwise("test").alias("split"),
        (F.col("id") % 11 == 0).alias("label"),
    )
    out = balanced_sample(df, "split", "label", "id", 3).groupBy("split").agg(
        F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n")
    )
    for row in out.collect():
        assert row["p"] == row["n"] > 0


def test_stratified_row_split_shares(spark):
    df = spark.range(2000).select("id", (F.col("id") % 4 == 0).alias("label"))
    out = stratified_row_split(df, "label", "id", {"train": 0.7, "val": 0.2, "test": 0.1}, 42)
    counts = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts == {
        (True, "train"): 350, (True, "val"): 100, (True, "test"): 50,
        (False, "train"): 1050, (False, "val"): 300, (False, "test"): 150,
    }
