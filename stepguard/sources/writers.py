"""Writers. None of them overwrites an existing result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.sources.manifest import fingerprints

REFUSE = "errorifexists"


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write JSON Lines and return the number of lines in the published files.

    The lines are counted afterwards and not observed during the write: once a
    session has an observation, forest models can no longer be sent to tasks.
    """
    df.write.mode(REFUSE).json(path)
    return df.sparkSession.read.text(path).count()


def publish_jsonl(df: DataFrame, path: str, part: Column, order: Sequence[str]) -> DataFrame:
    """Write JSON Lines in one ordered file per part, and tell what was published.

    The result has ``part``, ``rows``, ``bytes`` and ``sha256``, read from the files that
    are there afterwards. A part is one file, so choose parts that one task can write.
    """
    placed = df.withColumn("part", part)
    placed.repartition("part").sortWithinPartitions("part", *order).write.mode(REFUSE).partitionBy("part").json(path)
    spark = df.sparkSession
    number = F.regexp_extract("name", "part=([^/]*)/", 1).alias("part")
    files = fingerprints(spark, f"{path}/part=*/*.json").select("name", number, "bytes", "sha256")
    lines = spark.read.text(f"{path}/part=*/*.json").groupBy(
        F.regexp_extract("_metadata.file_path", "part=([^/]*)/", 1).alias("part")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return files.join(lines, "part").select("part", "rows", "bytes", "sha256")


def stack(frames: list[DataFrame]) -> DataFrame:
    """Tables with different columns in one; the header is their union, first seen first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode(REFUSE).option("header", True).csv(path)


def write_flagged(df: DataFrame, flag: Column, path: str) -> DataFrame:
    """Write the table once, laid out by flag, and return a reader of the flagged part.

    The flagged rows are a partition of the same table, so the second output
    costs no second write.
    """
    df.withColumn("flagged", F.coalesce(flag, F.lit(False))).write.mode(REFUSE).partitionBy(
        "flagged"
    ).parquet(path)
    return df.sparkSession.read.parquet(path).filter(F.col("flagged").cast("boolean")).drop("flagged")


def land(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Store as Parquet and read it back; the committer publishes only whole results."""
    writer = df.write.mode(REFUSE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
