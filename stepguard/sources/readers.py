"""Readers for records, predictions and split designs."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepguard.functions.numbers import group_key
from stepguard.sources.json_ranges import RANGE_BYTES, read_ranges


def read_json_array(
    spark: SparkSession, path: str, schema: StructType | str, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Records stored as one JSON array per file.

    Where a file is larger than ``range_bytes``, all are read by ranges of that size,
    so several tasks share a file; smaller files are read whole, one task each.
    """
    files = spark.read.format("binaryFile").load(path).select("length")
    if files.filter(F.col("length") > range_bytes).isEmpty():
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return read_ranges(spark, path, schema, range_bytes)


def read_jsonl(
    spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None
) -> DataFrame:
    """One JSON document per line; blank lines are skipped.

    With a limit these are the first lines, files taken in the order of their names.
    Files are opened in that order, in steps of doubling numbers, until they hold enough
    lines; no others are read, and only the last step's lines are numbered and ordered.
    """
    rows = spark.read.schema(schema).json(path)
    if limit is None:
        return rows
    files, needed, held, step = sorted(unquote(f) for f in rows.inputFiles()), [], 0, 1
    while held < limit and len(needed) < len(files):
        part = files[len(needed) : len(needed) + step]
        # lines per file, so the files that are not needed are left out again
        counts = dict(
            spark.read.text(part).filter(F.trim("value") != "").groupBy(F.col("_metadata.file_path")).count().collect()
        )
        by_name = {_place(name): n for name, n in counts.items()}
        for file in part:
            if held < limit:
                needed.append(file)
                held += by_name.get(_place(file), 0)
        step *= 2
    if not needed:
        return rows.limit(0)
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    # within a block, ids grow in the order of reading
    numbered = spark.read.schema(schema).json(needed).select(
        "*", *[F.col(p).alias(f"__{n}") for n, p in enumerate(place)], F.monotonically_increasing_id().alias("__2")
    )
    return numbered.orderBy("__0", "__1", "__2").limit(limit).drop("__0", "__1", "__2")


def _place(uri: str) -> str:
    """A file's name without its scheme; Spark writes local ones with one slash or three."""
    return unquote(re.sub("^file:/*", "/", uri))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; a byte order mark is dropped by Spark."""
    return spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(path)


def read_split_design(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(group, split) rows from design documents with a ``split_cycles`` map.

    A file is one document, or with ``lines`` each line is one that holds a part of the map.
    A group listed twice stops the job. Keys are compared as text.
    """
    design = (
        spark.read.schema("split_cycles map<string, array<string>>")
        .option("multiLine", not lines)
        .json(path)
    )
    listed = design.select(F.explode("split_cycles").alias("split", "groups")).select(
        "split", F.explode("groups").alias("group")
    )
    per_group = listed.groupBy(group_key(F.col("group")).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.min("split").alias("split")
    )
    twice = F.raise_error(
        F.concat(F.lit("group listed more than once: "), F.col("group"))
    ).cast("string")
    return per_group.select(
        "group", F.when(F.col("n") > 1, twice).otherwise(F.col("split")).alias("split")
    )
