"""JSON array files read by several tasks.

A file is cut into byte ranges. Whether a range begins inside of a string, and how deep,
isn't known from its bytes; a first pass counts, for each range, its quotes and how it
changes the depth for both beginnings, and sums over the ranges before tell the right
one. In the second pass each task finds the borders between the array's elements in its
range. An element belongs to the range that holds the border before it, so a record
across a cut is read once, by the task it begins in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RANGE_BYTES = 64 * 1024 * 1024
#: Bytes that are looked at together.
BLOCK = 1 << 22
LOOK_BACK = 1 << 10
#: Records that are returned together.
BATCH = 4096
#: Bytes of ranges that a task reads, where there are more ranges than ``SPREAD`` times the cores.
TASK_BYTES = 32 * 1024 * 1024
SPREAD = 4

QUOTE, ESCAPE, COMMA = ord('"'), ord("\\"), ord(",")
OPEN, CLOSE = [ord(c) for c in "[{"], [ord(c) for c in "]}"]


def structure(data: bytes, in_string: int, depth: int, escaped: int) -> tuple[np.ndarray, int, int, int]:
    """Borders of elements, then the state after the bytes.

    ``escaped`` is 1 after an odd number of backslashes. A border is the bracket that
    opens the array, a comma between elements or the bracket that ends it.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    slash = b == ESCAPE
    at = np.arange(len(b))
    last_other = np.maximum.accumulate(np.where(slash, -1 - (escaped & 1), at)) if len(b) else at
    before = np.concatenate([[-1 - (escaped & 1)], last_other[:-1]])
    odd = (at - 1 - before) % 2 == 1
    quotes = (b == QUOTE) & ~odd
    outside = (np.cumsum(quotes) + in_string) % 2 == 0
    change = (np.isin(b, OPEN) & outside).astype(np.int64) - (np.isin(b, CLOSE) & outside)
    deep = depth + np.cumsum(change)
    border = ((b == COMMA) & outside & (deep == 1)) | ((change == 1) & (deep == 1)) | ((change == -1) & (deep == 0))
    if not len(b):
        return np.flatnonzero(border), in_string, depth, escaped
    return np.flatnonzero(border), int((quotes.sum() + in_string) % 2), int(deep[-1]), int((len(b) - 1 - last_other[-1]) % 2)


def _opened(uri: str):
    from pyarrow import fs

    # Spark writes local paths with one slash.
    system, place = fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", uri))
    return system.open_input_file(place)


def _slashes_before(stream, start: int) -> int:
    """1 if an odd number of backslashes ends just before the place."""
    held = 0
    while start:
        step = min(start, LOOK_BACK)
        stream.seek(start - step)
        part = stream.read(step)
        bare = len(part.rstrip(b"\\"))
        held += len(part) - bare
        if bare:
            break
        start -= step
    return held % 2


def _blocks(stream, start: int, end: int) -> Iterator[bytes]:
    stream.seek(start)
    while start < end and (data := stream.read(min(BLOCK, end - start))):
        start += len(data)
        yield data


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, start, end in zip(batch["path"], batch["start"], batch["end"], strict=True):
            with _opened(path) as stream:
                escaped = _slashes_before(stream, start)
                states = [(0, 0, escaped), (1, 0, escaped)]
                for data in _blocks(stream, start, end):
                    states = [structure(data, *state)[1:] for state in states]
            rows.append((path, start, end, states[0][0], states[0][1], states[1][1]))
        yield pd.DataFrame(rows, columns=["path", "start", "end", "turns", "plain", "quoted"])


def _elements(path: str, start: int, end: int, in_string: int, depth: int) -> Iterator[bytes]:
    """The elements whose border lies in the range."""
    with _opened(path) as stream:
        escaped = _slashes_before(stream, start)
        stream.seek(start)
        held, place, state = None, start, (in_string, depth, escaped)
        while data := stream.read(BLOCK if place >= end else min(BLOCK, end - place)):
            if place == 0 and not data.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"["):
                raise ValueError(f"not a JSON array: {path}")
            borders, *state = structure(data, *state)
            before = 0
            for border in borders.tolist():
                if held is not None:
                    yield b"".join([*held, data[before:border]])
                before = border + 1
                if place + border >= end or data[border] in CLOSE:
                    held = None
                    if place + border >= end:
                        return
                else:
                    held = []
            if held is not None:
                held.append(data[before:])
            place += len(data)
            if place >= end and held is None:
                return


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for row in zip(*[batch[c].tolist() for c in ("path", "start", "end", "in_string", "depth")], strict=True):
            for element in _elements(*row):
                if element.strip():
                    found.append(element.decode("utf-8", "replace"))
                if len(found) == BATCH:
                    yield pd.DataFrame({"value": found})
                    found = []
        yield pd.DataFrame({"value": found}, dtype=object)


def json_ranges(files: DataFrame, range_bytes: int, tasks: int) -> DataFrame:
    """``path``, ``start``, ``end`` and the state ``in_string``, ``depth`` at the start of every range.

    ``files`` has ``path`` and ``length``.
    """
    cut = files.filter("length > 0").select(
        "path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {range_bytes})")).alias("n")
    )
    ranges = cut.select(
        "path", (F.col("n") * range_bytes).alias("start"), F.least("length", (F.col("n") + 1) * range_bytes).alias("end")
    ).repartitionByRange(tasks, "path", "start")
    measured = ranges.mapInPandas(
        _measured, "path string, start bigint, end bigint, turns int, plain bigint, quoted bigint"
    )
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = measured.withColumn("in_string", (F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2).cast("int"))
    change = F.when(F.col("in_string") == 0, F.col("plain")).otherwise(F.col("quoted"))
    return known.withColumn("change", change).select(
        "path", "start", "end", "in_string", F.coalesce(F.sum("change").over(earlier), F.lit(0)).cast("int").alias("depth")
    )


def read_tasks(ranges: int, held: int, spread: int) -> int:
    """Tasks for so many ranges with so many bytes: a range each, or several where there are many.

    What the driver hears of grows with tasks, and with their square in a shuffle, so
    their number follows the bytes and not the files, however small these are.
    """
    return max(1, min(ranges, max(spread, -(-held // TASK_BYTES))))


def read_ranges(spark: SparkSession, path: str, schema: StructType | str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of JSON array files, by ranges of this many bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    count = F.coalesce(F.sum(F.ceil(F.col("length") / range_bytes)), F.lit(0))
    ranges, held = files.agg(count, F.coalesce(F.sum("length"), F.lit(0))).first()
    # a given number of tasks: rows of ranges are small, so Spark would put them together
    tasks = read_tasks(int(ranges), int(held), SPREAD * spark.sparkContext.defaultParallelism)
    cut = json_ranges(files, range_bytes, tasks).repartitionByRange(tasks, "path", "start")
    texts = cut.mapInPandas(_read, "value string")
    return texts.select(F.from_json("value", schema).alias("record")).select("record.*")
