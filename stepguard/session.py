"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 1_000_000
SMALL_TABLE_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own, as in tests.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="stepguard-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Store a frame that several later branches read, so it is computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(
    df: DataFrame, max_rows: int = SMALL_TABLE_ROWS, max_bytes: int = SMALL_TABLE_BYTES
) -> DataFrame:
    """Hint a broadcast only when the table was measured and is small enough.

    Rows are counted, and their bytes as JSON text added up. A larger table is
    returned unhinted, so Spark joins it by a shuffle.
    """
    stored = checkpointed(df)
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, held = stored.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(stored) if rows <= max_rows and held <= max_bytes else stored
