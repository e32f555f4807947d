"""From raw documents to encoded training text, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all its predecessor
kept; all but the last return the columns of ``documents``. :func:`run` writes the
result of each stage as Parquet to the shared folder and reads it again for the
next one, so a lost executor never costs more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepguard.llm import line_dedup, mixing, near_text, pieces, quality_rules
from stepguard.llm.common import table
from stepguard.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the adaptive thresholds keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; lengths follow the texts."""
    shortened = line_dedup.drop_boilerplate(docs)
    counted = {"n_chars": F.length("text").cast("long")}
    return shortened.select(
        *[counted[c].alias(c) if c in counted else F.col(f"`{c}`") for c in docs.columns]
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies share five-word shingles with a similarity of 0.8 or more. Candidates are
    linked by SimHash and its BK-trees, and by MinHash buckets for what two bits don't reach.
    """
    return near_text.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources ask for."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces."""
    return pieces.with_pieces(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: SQL has no MinHash buckets, pivotal rounding or Viterbi search; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
