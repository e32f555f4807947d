"""Row-wise rules on a stream of records.

Each group keeps its last row (or its last steps) in keyed state. The rows of a group
in a micro-batch come in key order: Spark sorts them within partitions, on disk where
memory doesn't hold them, and the processor takes them batch after batch. So a group
may hold any share of a micro-batch, and a task holds one Arrow batch of it.

A row that is not newer than the stored key is passed on with ``late`` set, without a
previous value, and leaves the state alone; this is a choice made here, since a batch
table has no late rows.

With ``keep_for`` the state of a group ends that long after its last row, by the clock;
its next row then has no previous one. Such a query runs on as long as it isn't stopped.
Without it state has no end, and a query over the available input ends by itself.

Start such streams with :func:`start`: Spark's check for streams refuses every sort,
also one within a micro-batch, and the state needs the RocksDB store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StructField,
    StructType,
)

from stepguard.operators.adjacent import add_differences
from stepguard.operators.rules import Rule, add_labels


def table_stream(
    spark: SparkSession,
    folder: str,
    name: str,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
) -> DataFrame:
    """A stream over one table of a folder: a single Parquet file or a folder of part files.

    With a limit the files are read in the order in which they were written, a few
    per micro-batch. A missing or empty table is an error.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema  # fails where nothing can be read
    source = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger is not None:
        source = source.option("maxBytesPerTrigger", bytes_per_trigger)
    # a pattern that matches this name only finds a file as well as a folder
    return source.parquet(f"{path[:-1]}[{path[-1]}]")


# Names of Spark settings.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHECK = "spark.sql.streaming.unsupportedOperationCheck"


def start(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream of this module; the settings it needs hold for its start only."""
    before = {name: spark.conf.get(name, None) for name in (_STORE, _CHECK)}
    try:
        spark.conf.set(_STORE, _ROCKS)
        spark.conf.set(_CHECK, "false")
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class _InOrder(StatefulProcessor):
    """Takes the rows of a group in key order and tells which are late."""

    def __init__(self, order: Sequence[str], keep_for: timedelta | None) -> None:
        self.order = list(order)
        self.keep_ms = None if keep_for is None else max(1, int(keep_for.total_seconds() * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        keys = StructType([StructField(f"key_{o}", LongType()) for o in self.order])
        self.newest = handle.getValueState("newest", keys, self.keep_ms)

    def batches(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.Series]]:
        """Batches with their late rows; the newest key is stored at the end."""
        known = newest = tuple(self.newest.get()) if self.newest.exists() else None
        last = None
        for batch in rows:
            if not len(batch):
                continue
            ends = [tuple(int(batch[o].iloc[i]) for o in self.order) for i in (0, -1)]
            if ends[0] > ends[1] or (last is not None and ends[0] < last):
                raise RuntimeError("rows of a group don't come in order: keep the number of shuffle partitions")
            batch, last = batch.reset_index(drop=True), ends[1]
            late = _late(batch, self.order, known)
            if not late.all():
                newest = ends[1]
            yield batch, late
        if newest != known:
            self.newest.update(newest)

    def close(self) -> None:
        pass


def _late(rows: pd.DataFrame, order: Sequence[str], newest: tuple | None) -> pd.Series:
    if newest is None:
        return pd.Series(False, index=rows.index)
    late = pd.Series(True, index=rows.index)
    undecided = late.copy()
    for name, value in zip(order, newest):
        late &= ~(undecided & (rows[name] > value))
        undecided &= rows[name] == value
    return late


def _keyed(stream: DataFrame, group: str, order: Sequence[str], processor: _InOrder, out: StructType) -> DataFrame:
    parts = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        stream.repartition(parts, group)
        .sortWithinPartitions(group, *order)
        .groupBy(group)
        .transformWithStateInPandas(processor, out, "append", "None" if processor.keep_ms is None else "ProcessingTime")
    )


class _PreviousRow(_InOrder):
    def __init__(self, order, keep_for, channels, prefix, names) -> None:
        super().__init__(order, keep_for)
        self.channels, self.prefix, self.names = list(channels), prefix, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        values = StructType([StructField(c, DoubleType()) for c in self.channels])
        self.previous = handle.getValueState("previous", values, self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = tuple(self.previous.get()) if self.previous.exists() else None
        seen = False
        for batch, late in self.batches(rows):
            fresh = batch[~late]
            values = fresh[self.channels].astype("float64")
            before = values.shift(1)
            if held is not None and len(before):
                before.iloc[0] = [np.nan if v is None else v for v in held]
            for name in self.channels:
                batch[f"{self.prefix}{name}"] = before[name]
            batch["late"] = late
            if len(values):
                held, seen = tuple(None if pd.isna(v) else float(v) for v in values.iloc[-1]), True
            yield batch[self.names]
        if seen:
            self.previous.update(held)


def with_previous(
    stream: DataFrame,
    group: str,
    order: Sequence[str],
    channels: Sequence[str],
    prefix: str = "previous_",
    keep_for: timedelta | None = None,
) -> DataFrame:
    """Previous channel values per group, kept across micro-batches.

    Order columns must be whole numbers, for example event time in microseconds.
    """
    out = StructType(
        list(stream.schema.fields)
        + [StructField(f"{prefix}{c}", DoubleType()) for c in channels]
        + [StructField("late", BooleanType())]
    )
    processor = _PreviousRow(order, keep_for, channels, prefix, [f.name for f in out.fields])
    return _keyed(stream, group, order, processor, out)


def label_stream(
    stream: DataFrame,
    group: str,
    order: Sequence[str],
    channels: Sequence[str],
    rules: Sequence[Rule],
    state: str = "state",
    keep_for: timedelta | None = None,
) -> DataFrame:
    """Rules on every arriving row. The rule columns are the batch ones."""
    stepped = with_previous(stream, group, order, channels, keep_for=keep_for)
    clean = stepped.withColumns(
        {
            f"previous_{c}": F.when(~F.isnan(f"previous_{c}"), F.col(f"previous_{c}"))
            for c in channels
        }
    )
    return add_labels(add_differences(clean, channels), rules, state)


class _Steps(_InOrder):
    """Keeps the last steps of a group as a list of that length."""

    def __init__(self, order, keep_for, features, length, names) -> None:
        super().__init__(order, keep_for)
        self.features, self.length, self.names = list(features), length, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        step = StructType([StructField("step", ArrayType(DoubleType()))])
        self.steps = handle.getListState("steps", step, self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        width, length = len(self.features), self.length
        held = [[np.nan if v is None else v for v in step] for (step,) in self.steps.get()] if self.steps.exists() else []
        history, seen = np.array(held, dtype=np.float64).reshape(-1, width), False
        for batch, late in self.batches(rows):
            fresh = batch[~late]
            batch["sequence"], batch["late"] = None, late
            if len(fresh):
                known = len(history)
                history = np.concatenate([history, fresh[self.features].astype("float64").to_numpy()])
                # the first step stands for those before it
                padded = np.concatenate([np.repeat(history[:1], length - 1, axis=0), history])
                windows = np.lib.stride_tricks.sliding_window_view(padded, length, axis=0)[known:]
                batch["sequence"] = pd.Series(
                    windows.transpose(0, 2, 1).tolist(), index=fresh.index, dtype=object
                ).reindex(batch.index)
                batch.loc[late, "sequence"] = None
                history, seen = history[-length:], True
            yield batch[self.names]
        if seen:
            self.steps.put([(step,) for step in history.tolist()])


def sequence_stream(
    stream: DataFrame,
    group: str,
    order: Sequence[str],
    features: Sequence[str],
    length: int = 8,
    keep_for: timedelta | None = None,
) -> DataFrame:
    """The last ``length`` feature steps per arriving row, padded on the left."""
    keep = [f for f in stream.schema.fields if f.name not in features]
    out = StructType(
        keep
        + [
            StructField("sequence", ArrayType(ArrayType(DoubleType()))),
            StructField("late", BooleanType()),
        ]
    )
    processor = _Steps(order, keep_for, features, length, [f.name for f in out.fields])
    return _keyed(stream, group, order, processor, out)


def running_counts(labelled: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Counters per group, state or rule; use the update or complete output mode."""
    return labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(name)).alias(name) for name in names],
    )


def publish_counts(batch: DataFrame, batch_id: int, path: str) -> None:
    """Store the changed counters of a micro-batch under its id.

    A batch that is repeated after a failure replaces what it wrote, so it counts once.
    """
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def current_counts(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """The newest counters of each key."""
    stored = spark.read.parquet(path)
    names = [c for c in stored.columns if c not in (*by, "batch")]
    newest = stored.groupBy(*by).agg(F.max_by(F.struct(*names), "batch").alias("newest"))
    return newest.select(*by, "newest.*")


def run_counts(counts: DataFrame, by: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Drain the available input into counters, in update mode: only changed keys are written."""
    writer = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: publish_counts(batch, batch_id, path))
        .trigger(availableNow=True)
    )
    writer.start().awaitTermination()
    return current_counts(counts.sparkSession, path, by)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain the available input into a Parquet table and read that table."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    start(stream.sparkSession, writer).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
