"""Size and SHA-256 of files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE_FILE_BYTES = 64 * 1024 * 1024
BLOCK = 1024 * 1024


def fingerprints(spark: SparkSession, path: str, whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """(name, bytes, sha256) for every file below a path or glob.

    A name is the path below the part of ``path`` without wildcards, so files of
    one name in several folders stay apart.

    Small files are read and hashed inside the JVM. A larger file is streamed
    in blocks by one task each, since a hash cannot be split and the file must
    not be held in memory. A scan leaves out empty files, so these are added
    from the listing that Spark keeps for the scan.
    """
    files = spark.read.format("binaryFile").load(path)
    root = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    root = _plain(root if root == path else root.rpartition("/")[0])

    def name(column: str) -> Column:
        whole = F.regexp_replace(column, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/")
        below = F.when(F.startswith(whole, F.lit(f"{root}/")), F.substring(whole, len(root) + 2, 1 << 30))
        return F.coalesce(below, F.element_at(F.split(whole, "/"), -1)).alias("name")

    small = files.filter(F.col("length") <= whole_file_bytes).select(
        name("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    large = (
        files.filter(F.col("length") > whole_file_bytes)
        .select("path", "length")
        .mapInPandas(_stream_hashes, "path string, length bigint, sha256 string")
        .select(name("path"), F.col("length").alias("bytes"), "sha256")
    )
    listed = spark.createDataFrame([(unquote(uri),) for uri in files.inputFiles()], "path string")
    return listed.select(name("path")).join(small.unionByName(large), "name", "left").select(
        "name",
        F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"),
    )


def _plain(path: str) -> str:
    """A path without scheme, host and a slash at its end."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/", path).rstrip("/")


def _stream_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        hashes = []
        for uri in batch["path"]:
            # Spark writes local paths with one slash.
            system, place = fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", uri))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while block := stream.read(BLOCK):
                    digest.update(block)
            hashes.append(digest.hexdigest())
        yield batch.assign(sha256=hashes)
