"""Several micro-batches must give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from stepguard.plans import events as ev
from stepguard.streaming.labels import (
    current_counts,
    label_stream,
    publish_counts,
    run_counts,
    run_to_table,
    running_counts,
    sequence_stream,
    start,
    table_stream,
    with_previous,
)


@pytest.fixture(scope="module")
def pieces(spark, folder, tmp_path_factory):
    """The events in four files in time order, read one file per micro-batch."""
    root = tmp_path_factory.mktemp("stream") / "in"
    df = ev.events(spark, folder).withColumn("part", F.ntile(4).over(_by_time()))
    import os
    import time

    for part in range(1, 5):
        path = f"{root}/{part}"
        df.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{name}", (time.time() - 1000 + part * 100,) * 2)
    return str(root), df.drop("part").schema


def _by_time():
    from pyspark.sql import Window

    return Window.orderBy(*ev.ORDER)


def open_stream(spark, pieces):
    root, schema = pieces
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(root)
    )


def test_labels_across_batches(spark, folder, pieces, tmp_path):
    stream = label_stream(open_stream(spark, pieces), ev.GROUP, ev.ORDER, ev.CHANNELS, ev.RULES)
    got = run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    columns = ["event_id", "previous_value", "previous_k", *ev.RULE_NAMES, "is_anomaly"]
    wanted = ev.labelled(ev.events(spark, folder)).select(columns)
    assert got.filter("late").count() == 0
    assert got.select(columns).exceptAll(wanted).count() == 0
    assert got.count() == wanted.count()


def test_sequences_across_batches(spark, folder, pieces, tmp_path):
    from stepguard.operators.adjacent import rolling_sequence

    source = open_stream(spark, pieces).select("event_id", "ts_us", "user_id", "value", "k")
    out = sequence_stream(source, ev.GROUP, ev.ORDER, ["value", "k"], 8)
    got = run_to_table(out, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = rolling_sequence(
        ev.events(spark, folder), [ev.GROUP], ev.ORDER, F.array("value", "k"), 8
    ).select("event_id", "sequence")
    assert got.select("event_id", "sequence").exceptAll(batch).count() == 0
    assert got.count() == batch.count()


def test_late_rows_leave_the_state_alone(spark, tmp_path):
    schema = "g string, t bigint, v double"
    import os
    import time

    batches = [[("a", 10, 1.0), ("b", 1, None)], [("a", 5, 50.0), ("a", 20, 3.0), ("b", 2, 4.0)], [("a", 30, 9.0), ("b", 3, 6.0)]]
    root = tmp_path / "in"
    for i, rows in enumerate(batches):
        path = f"{root}/{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{name}", (time.time() - 1000 + i * 100,) * 2)
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(root))
        .withColumn("state", F.lit("s"))
    )
    labelled = label_stream(stream, "g", ["t"], ["v"], [])
    rows = run_to_table(labelled, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    got = {(r["g"], r["t"]): (r["previous_v"], r["late"]) for r in rows}
    assert got == {
        ("a", 10): (None, False), ("a", 5): (None, True), ("a", 20): (1.0, False),
        ("a", 30): (3.0, False), ("b", 1): (None, False), ("b", 2): (None, False),
        ("b", 3): (4.0, False),
    }


def test_running_counters(spark, folder, pieces, tmp_path):
    """Each micro-batch writes changed counters; a batch that comes again counts once."""
    stream = open_stream(spark, pieces).withColumn("big", F.col("value") > 50)
    path = str(tmp_path / "counts")
    counts = running_counts(stream, ["state"], ["big"])
    got = run_counts(counts, ["state"], path, str(tmp_path / "state"))
    rows = ev.events(spark, folder).groupBy("state").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("big")
    )
    wanted = sorted(map(str, rows.collect()))
    assert sorted(map(str, got.collect())) == wanted
    batches = sorted(r["batch"] for r in spark.read.parquet(path).select("batch").distinct().collect())
    assert batches == [0, 1, 2, 3]
    for batch in (1, 3):
        repeated = spark.createDataFrame(spark.read.parquet(f"{path}/batch={batch}").collect(), counts.schema)
        publish_counts(repeated, batch, path)
    assert sorted(map(str, current_counts(spark, path, ["state"]).collect())) == wanted


def test_folder_and_file_tables_stream_alike(spark, folder, tmp_path):
    raw = spark.read.parquet(f"{folder}/events.parquet")
    raw.repartition(7).write.parquet(f"{tmp_path}/parts/events.parquet")
    for n, place in enumerate((folder, f"{tmp_path}/parts")):
        stream = ev.from_raw(table_stream(spark, place, "events"))
        labels = label_stream(stream, ev.GROUP, ev.ORDER, ev.CHANNELS, ev.RULES)
        got = run_to_table(labels, f"{tmp_path}/out{n}", f"{tmp_path}/state{n}")
        wanted = ev.labelled(ev.events(spark, folder))
        columns = ["event_id", "previous_value", *ev.RULE_NAMES]
        assert got.count() == raw.count() and got.filter("late").count() == 0
        assert got.select(columns).exceptAll(wanted.select(columns)).count() == 0


def test_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        table_stream(spark, str(tmp_path), "events")


def test_hot_group_over_several_triggers(spark, tmp_path):
    """One group holds nearly all rows, which arrive in five files, two per trigger."""
    import time

    from stepguard.operators.adjacent import rolling_sequence

    rows = [("hot" if i % 10 else "cold", i, float(i * 7 % 31)) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, t bigint, v double")
    path = f"{tmp_path}/events.parquet"
    for part in range(5):
        frame.filter((F.col("t") >= part * 100) & (F.col("t") < part * 100 + 100)).coalesce(1).write.mode(
            "append"
        ).parquet(path)
        time.sleep(1.1)
    stream = table_stream(spark, str(tmp_path), "events", files_per_trigger=2)
    out = sequence_stream(stream.withColumn("w", F.col("v") + 1), "g", ["t"], ["v", "w"], 4)
    got = run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/state")
    wanted = rolling_sequence(
        frame.withColumn("w", F.col("v") + 1), ["g"], ["t"], F.array("v", "w"), 4
    ).select("g", "t", "sequence")
    assert got.count() == 500 and got.filter("late").count() == 0
    assert got.select("g", "t", "sequence").exceptAll(wanted).count() == 0


def test_hot_group_in_small_batches(spark, tmp_path):
    """One group fills many Arrow batches of a micro-batch that is not in order: none holds more than 50 rows."""
    frame = spark.range(3000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("g"), F.col("id").alias("t"), (F.col("id") * 7 % 31).cast("double").alias("v")
    ).orderBy(F.hash("t"))
    for part in range(3):
        frame.filter(F.col("t").between(part * 1000, part * 1000 + 999)).repartition(4).write.parquet(f"{tmp_path}/in/{part}")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "50")
    try:
        stream = spark.readStream.schema("g string, t long, v double").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        got = run_to_table(with_previous(stream, "g", ["t"], ["v"]), f"{tmp_path}/out", f"{tmp_path}/state")
    finally:
        spark.conf.set(setting, before)
    wanted = frame.select("g", "t", F.expr("lag(v) OVER (PARTITION BY g ORDER BY t)").alias("previous_v"))
    assert got.count() == 3000 and got.filter("late").count() == 0
    nan = F.when(~F.isnan("previous_v"), F.col("previous_v")).alias("previous_v")
    assert got.select("g", "t", nan).exceptAll(wanted).count() == 0


def test_state_ends(spark, tmp_path):
    """Rows within the time to live see the row before; later ones start anew."""
    import time
    from datetime import timedelta

    def arrive(t):
        spark.createDataFrame([("a", t, float(t))], "g string, t long, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{t}")

    def wait_for(t):
        for _ in range(240):
            found = [r.previous_v for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").filter(F.col("t") == t).collect()]
            if found:
                return found
            time.sleep(0.25)
        raise AssertionError(query.exception())

    arrive(1)
    (tmp_path / "out").mkdir()
    stream = spark.readStream.schema("g string, t long, v double").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = with_previous(stream, "g", ["t"], ["v"], keep_for=timedelta(seconds=30))
    writer = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    query = start(spark, writer.trigger(processingTime="500 milliseconds"))
    try:
        assert wait_for(1) == [None]
        arrive(2)
        assert wait_for(2) == [1.0]
        time.sleep(32)
        arrive(3)
        assert wait_for(3) == [None]
    finally:
        query.stop()
