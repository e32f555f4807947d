"""Cases that small, clean tables don't show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepguard.operators import align as al
from stepguard.sources.readers import read_jsonl
from stepguard.functions.hashing import mixed_integer, mixed_integers
from stepguard.operators import evaluate as ea
from stepguard.operators import sampling as sa
from stepguard.operators import splits as sp
from stepguard.operators.forests import fit_isolation_forest, score_isolation_forest
from stepguard.plans import events as ev
from stepguard.session import broadcast_if_small
from stepguard.sources.manifest import fingerprints
from stepguard.sources.readers import read_jsonl


def test_copies_get_ids_that_no_record_has(spark):
    df = spark.range(0, 3_000_000, 1000).select(F.col("id").alias("event_id"))
    copies = sa.replicated(df, "event_id", 3, sa.beyond(df, "event_id"))
    assert copies.select("event_id").distinct().count() == copies.count() == 9000


def test_files_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    import hashlib

    for name, data in (("a", b"one"), ("b", b"two"), ("c", b"")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(data)
    found = {r["name"]: r["sha256"] for r in fingerprints(spark, f"{tmp_path}/*/part-*").collect()}
    assert found == {
        f"{n}/part-0": hashlib.sha256(d).hexdigest() for n, d in (("a", b"one"), ("b", b"two"), ("c", b""))
    }
    assert {r["name"] for r in fingerprints(spark, str(tmp_path / "a")).collect()} == {"part-0"}


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_scores_without_a_place_stop_the_curve(spark, bad):
    rows = [(True, 0.9), (False, 0.1), (False, bad)]
    df = spark.createDataFrame(rows, "gold boolean, score double")
    with pytest.raises(Exception, match="null or not finite"):
        ea.score_curve(df, [], "gold", "score").collect()


def test_null_strata_are_drawn_like_others(spark):
    rows = [(i, None if i % 2 else "train", i % 10 < 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, split string, label boolean").cache()
    drawn = sa.balanced_sample(df, "split", "label", "id", 1)
    got = {(r["split"], r["label"]): r["count"] for r in drawn.groupBy("split", "label").count().collect()}
    assert got == {(s, v): 40 for s in (None, "train") for v in (True, False)}
    parts = sa.stratified_row_split(
        df.withColumn("label", F.when(F.col("id") >= 100, F.col("label"))), "label", "id",
        {"train": 0.5, "val": 0.3, "test": 0.2}, 1,
    )
    sizes = {r["split"]: r["count"] for r in parts.filter("label IS NULL").groupBy("split").count().collect()}
    assert sizes == {"train": 50, "val": 30, "test": 20}


def test_times_without_zone_do_not_follow_the_session(spark, folder):
    raw = spark.read.parquet(f"{folder}/events.parquet")
    here = ev.from_raw(raw).agg(F.sum("ts_us"), F.min("ts_us")).first()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert ev.from_raw(raw).agg(F.sum("ts_us"), F.min("ts_us")).first() == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    early = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:58.5' AS t")
    assert early.select(ev.epoch_micros("t", "timestamp_ntz")).first()[0] == -1_500_000


def test_search_without_a_valid_trial_stops(spark):
    few = spark.createDataFrame([("a", 10, 1)], "g string, total bigint, anomaly bigint")
    with pytest.raises(Exception, match="no trial selects two groups"):
        sp.stratified_group_split(few, "g", trials=20).collect()
    none = spark.createDataFrame([(f"g{i}", 10, 0) for i in range(40)], "g string, total bigint, anomaly bigint")
    with pytest.raises(Exception, match="no trial selects two groups"):
        sp.stratified_group_split(none, "g", trials=20).collect()


def test_trials_in_vectors_agree_with_rows(spark):
    for count, trials in ((30, 200), (5000, 20)):
        groups = spark.range(count).select(
            (F.col("id") * 70_001_123 % 2_147_483_647).alias("base"), (F.col("id") + 5).alias("total"),
            (F.col("id") % 4).alias("anomaly"),
        ).repartition(4)
        got = sp.trial_scores(groups, trials, 0.2, F.lit(100.0), F.lit(0.1)).drop("score").collect()
        rows = groups.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trials - 1).cast("bigint"))).alias("trial"))
        wanted = rows.filter(sp.chosen_in(F.col("base"), F.col("trial"), 0.2)).groupBy("trial").agg(
            F.count(F.lit(1)).alias("groups"), F.sum("total").alias("total"), F.sum("anomaly").alias("anomaly")
        ).filter("groups >= 2").collect()
        order = ["trial", "groups", "total", "anomaly"]
        assert sorted(tuple(r[c] for c in order) for r in got) == sorted(tuple(r[c] for c in order) for r in wanted)
        assert abs(sum(r["groups"] for r in got) / trials / count - 0.2) < 0.02
    assert mixed_integers(5, np.arange(3)).tolist() == [
        spark.range(1).select(mixed_integer(F.lit(5).cast("bigint"), F.lit(t).cast("bigint"))).first()[0] for t in range(3)
    ]


def test_equal_sequences_need_no_join(spark):
    """Tables with the same keys in the same order agree by their digests; else the positions are joined."""
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 2003).alias("o"))
    keys, order = ["k"], ["o", "k"]
    same = al.order_check(rows.repartition(5), rows.repartition(3), keys, order)
    assert "Join" not in plan_of(same)
    assert same.first().asDict() == {"left_rows": 2000, "right_rows": 2000, "mismatched_positions": 0}
    swapped = rows.withColumn("k", F.expr("CASE WHEN k = 5 THEN 9 WHEN k = 9 THEN 5 ELSE k END"))
    found = al.order_check(rows, swapped, keys, ["o"])
    assert found.first().asDict() == {"left_rows": 2000, "right_rows": 2000, "mismatched_positions": 2}
    shorter = al.order_check(rows, rows.filter("o < 1990"), keys, order)
    assert shorter.first()["mismatched_positions"] == shorter.first()["left_rows"] - shorter.first()["right_rows"] > 0
    empty = rows.filter("k < 0")
    assert al.order_check(empty, empty, keys, order).first().asDict() == {"left_rows": 0, "right_rows": 0, "mismatched_positions": 0}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_first_lines_read_only_the_files_they_need(spark, tmp_path):
    for part in range(6):
        spark.range(part * 100, part * 100 + 100).coalesce(1).write.json(f"{tmp_path}/in/{part}")
    path = f"{tmp_path}/in/*"
    for limit, files in ((1, 1), (150, 2), (250, 3), (10_000, 6)):
        frame = read_jsonl(spark, path, "id bigint", limit)
        assert [r.id for r in frame.collect()] == list(range(min(limit, 600)))
        assert len(frame.inputFiles()) == files
    assert read_jsonl(spark, path, "id bigint", 0).count() == 0


def test_few_rows_scale_scores_by_what_trees_hold(spark):
    """The mean row of a tree over all rows scores about a half, at any number of rows."""
    df = spark.range(40).select("id", F.array(F.rand(2), F.rand(3)).alias("x")).cache()
    nodes = fit_isolation_forest(df, "id", "x", 50, 256, 1)
    assert nodes.filter("node = 0").agg(F.max("rows")).first()[0] <= 40
    mean = score_isolation_forest(df, nodes, "x").agg(F.avg("score")).first()[0]
    assert 0.4 < mean < 0.6


def test_broadcasts_are_measured_in_bytes(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 2_000_000).alias("t"))
    other = spark.range(10)
    plan = lambda df: other.join(df, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(broadcast_if_small(wide))
    assert "broadcast" not in plan(broadcast_if_small(wide, max_bytes=1_000_000))
    assert "broadcast" not in plan(broadcast_if_small(wide, max_rows=5))


def test_first_lines_are_the_first_in_file_order(spark, tmp_path):
    path = f"{tmp_path}/lines"
    spark.range(1000).repartitionByRange(6, "id").sortWithinPartitions("id").write.json(path)
    assert [r["id"] for r in read_jsonl(spark, path, "id bigint", limit=400).collect()] == list(range(400))


def test_every_tree_has_its_rows(spark):
    """Exactly the sample size, also where a first draw comes out short; all rows of small tables."""
    from stepguard.operators.forests import tree_samples

    for total, wanted in ((5000, 64), (70, 64), (40, 40), (1, 1)):
        df = spark.range(total).select("id", F.array(F.col("id").cast("double")).alias("x"))
        counts = tree_samples(df, "id", "x", 50, 64, 3).groupBy("tree").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("d")
        ).collect()
        assert sorted(r["tree"] for r in counts) == list(range(50))
        assert {(r["n"], r["d"]) for r in counts} == {(wanted, wanted)}


def test_forests_return_their_results(spark, folder):
    """Scores, importances and metrics are there, and rank better than chance."""
    from stepguard.plans.catalog import QUERIES

    metrics = QUERIES["i05_baseline_metrics"](spark, folder).collect()
    assert {(r["method"], r["dataset"]) for r in metrics} >= {(m, "test_natural") for m in ("isolation_forest", "random_forest")}
    assert min(r["auroc"] for r in metrics if r["method"] == "random_forest" and r["dataset"].startswith("test")) > 0.9
    assert min(r["auroc"] for r in metrics if r["method"] == "isolation_forest" and r["dataset"].startswith("test")) > 0.5
    importances = {r["feature"]: r["importance"] for r in QUERIES["i04_feature_importances"](spark, folder).collect()}
    assert abs(sum(importances.values()) - 1) < 1e-9
    # what the most frequent rule reads stands in front
    assert {"state_purchase", "f_value_diff"} <= set(sorted(importances, key=importances.get)[-3:])
    rows = QUERIES["i03_isolation_predictions"](spark, folder)
    assert rows.filter("score <= 0 OR score > 1 OR pred != (score >= threshold)").count() == 0


def test_published_files(spark, tmp_path):
    import hashlib

    from stepguard.sources.writers import publish_jsonl

    df = spark.range(50).select("id", F.lit("ü").alias("t"))
    got = {r["part"]: (r["rows"], r["bytes"], r["sha256"]) for r in publish_jsonl(df, f"{tmp_path}/out", F.floor(F.col("id") / 20), ["id"]).collect()}
    for part in range(3):
        text = "".join(f'{{"id":{i},"t":"ü"}}\n' for i in range(part * 20, min(50, part * 20 + 20))).encode()
        assert got[str(part)] == (text.count(b"\n"), len(text), hashlib.sha256(text).hexdigest())
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        publish_jsonl(df, f"{tmp_path}/out", F.lit(1), ["id"])


def test_all_trees_together_give_the_path_sums_of_each(spark):
    """Rows go down all trees at once, NaN to the right; sums are those of a walk tree by tree."""
    from stepguard.operators import forests as fo

    random = np.random.default_rng(3)
    table = fo.pd.concat([fo.grow_tree(t, random.normal(size=(n, 3)), 1) for t, n in enumerate((64, 1, 2, 40, 64))])
    rows = random.normal(size=(700, 3))
    rows[5, 1] = np.nan
    wanted = np.zeros(700)
    for _, part in table.groupby("tree"):
        nodes = part.sort_values("node").to_dict("records")
        for i, row in enumerate(rows):
            here = nodes[0]
            while here["feature"] >= 0:
                here = nodes[here["left"] if row[here["feature"]] <= here["threshold"] else here["right"]]
            wanted[i] += here["path"]
    assert (fo.flat_forest(table).path_sums(rows) == wanted).all()
    assert (fo.flat_forest(table[:0]).path_sums(rows) == 0).all()


def test_scoring_tasks_follow_the_rows(spark):
    """One large partition among small ones is dealt out again before it is scored."""
    from stepguard.operators import forests as fo

    rows = spark.range(0, 250_000, 1, 1).union(spark.range(0, 10, 1, 3))
    held = fo.spread(rows).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 3 and max(r["count"] for r in held) <= fo.TASK_ROWS
    assert fo.spread(spark.range(0)).count() == 0


def test_a_trial_draws_for_each_group(spark):
    """Groups whose bases agree in their last digits are selected independently of one another."""
    groups = spark.range(2).select(
        (F.col("id") * 1024 + 7).alias("base"), F.lit(1).cast("bigint").alias("total"), F.col("id").alias("anomaly")
    )
    both = sp.trial_scores(groups, 4000, 0.3, F.lit(1.0), F.lit(0.5)).count()
    assert abs(both / 4000 - 0.09) < 0.02
    bases = np.array([[5], [2_147_483_646]])
    assert (mixed_integers(bases, np.arange(9)[None])[1] == mixed_integers(2_147_483_646, np.arange(9))).all()
    assert sp._first_beyond(0.5) == 1_073_741_824 and sp._first_beyond(0.0) == 0


def test_rows_keep_their_nodes_while_a_forest_grows(spark):
    from stepguard.operators import forests as fo

    rows = spark.range(200).select((F.col("id") % 3 == 0).alias("gold"), F.array((F.col("id") % 3).cast("double")).alias("x"))
    model = fo.fit_random_forest(rows, "gold", "x", trees=3, depth=4)
    assert model.getCacheNodeIds() and model.getNumTrees == 3
    scored = fo.score_random_forest(model, rows, "x")
    assert scored.filter((F.col("score") > 0.5) != F.col("gold")).count() == 0


def test_a_large_table_grows_a_tree_to_a_task(spark, monkeypatch):
    """The law is that of MLlib's forest: bootstrap rows, 32 bins, random features, pure leaves."""
    from stepguard.operators import forests as fo

    rows = spark.range(4000).select(
        F.array(F.rand(1), F.rand(2), (F.col("id") % 2).cast("double")).alias("x")
    ).withColumn("gold", (F.col("x")[0] > 0.8) & (F.col("x")[1] < 0.5)).cache()
    old = fo.fit_random_forest(rows, "gold", "x", trees=30)
    monkeypatch.setattr(fo, "TREE_ROWS", 4000)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grown", "grown")
    grown = fo.fit_random_forest(rows, "gold", "x", trees=30)
    assert len(jobs.getJobIdsForGroup("grown")) < 12  # not a job for each level
    assert isinstance(grown, fo.GrownForest) and grown.getNumTrees == 30
    assert sum(grown.featureImportances) == pytest.approx(1.0)
    assert np.allclose(grown.featureImportances.toArray(), old.featureImportances.toArray(), atol=0.06)
    errors = []
    for model in (old, grown):
        scored = fo.score_random_forest(model, rows, "x")
        errors.append(scored.filter((F.col("score") > 0.5) != F.col("gold")).count())
    assert max(errors) < 80
    again = fo.fit_random_forest(rows, "gold", "x", trees=2)
    assert all(list(a["threshold"]) == list(b["threshold"]) for a, b in zip(again.trees, grown.trees[:2], strict=True))
    monkeypatch.setattr(fo, "SMALL_TABLE_BYTES", 4000 * 4 - 1)
    assert not isinstance(fo.fit_random_forest(rows, "gold", "x", trees=2, depth=2), fo.GrownForest)


def test_scores_are_those_of_mllib(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from stepguard.operators import forests as fo
    from stepguard.operators import trees as tr

    rows = spark.range(900).select(
        F.array(*(F.round(F.rand(i), 2) for i in range(4))).alias("x"), (F.rand(9) < 0.3).alias("gold")
    ).cache()
    model = fo.fit_random_forest(rows, "gold", "x", trees=7, depth=9)
    beside = rows.select("x", F.lit(0)).union(spark.sql("SELECT array(double('NaN'), 0.5D, -1D, 7D), 1"))
    wanted = model.transform(beside.withColumn("vector", array_to_vector("x"))).select(
        "x", F.get(vector_to_array("probability"), F.lit(1)).alias("p")
    )
    wanted = sorted((str(r.x), r.p) for r in wanted.collect())
    for nodes, held in ((1024, 32_768), (4, 100), (0, 64)):
        monkeypatch.setattr(tr, "SET_NODES", nodes)
        found = tr.scorer(tr.mllib_trees(spark, model), 4)
        x = [r.x for r in beside.collect()]
        monkeypatch.setattr(tr, "ROWS_HELD", held)
        assert sorted(zip(map(str, x), found.probabilities(np.array(x)), strict=True)) == wanted
    scored = fo.score_random_forest(model, beside, "x")
    assert sorted((str(r.x), r.score) for r in scored.collect()) == wanted


def test_a_grown_tree_splits_while_it_gains():
    from stepguard.operators import trees as tr

    assert tr.edges(np.array([1.0, 1.0, 1.0])).tolist() == []
    assert tr.edges(np.array([2.0, 0.0, 0.0])).tolist() == [1.0]
    assert len(tr.edges(np.arange(1000.0))) == 31
    random = np.random.default_rng(0)
    x = random.random((600, 3))
    y = (x[:, 0] > 0.5).astype(np.uint8)
    cuts = [tr.edges(x[:, f]) for f in range(3)]
    tree = tr.grow(tr.BinnedRows(tr.binned(x, cuts, np.uint8), y, cuts), 0, 30, 1)
    inner = tree["feature"] >= 0
    weights = tree["weights"].reshape(-1, 2)
    assert (weights[inner] > 0).all() and (tree["left"][~inner] == -1).all()
    assert weights[inner] == pytest.approx(weights[tree["left"][inner]] + weights[tree["right"][inner]])
    for rows in (np.zeros((0, 3)), x[:1]):  # no row, and one
        few = tr.BinnedRows(tr.binned(rows, cuts, np.uint8), y[: len(rows)], cuts)
        assert tr.grow(few, 0, 30, 1)["feature"].tolist() == [-1]
    one = tr.grow(tr.BinnedRows(tr.binned(x, cuts, np.uint8), y, cuts), 0, 0, 1)
    assert one["feature"].tolist() == [-1]
