"""Registered queries of the text operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepguard.llm import content_sort, eigen_whitening, hard_negatives, html_extraction, line_dedup, mixing, pieces, pitman_yor, quality_rules, secret_scan, sharding, simhash, winnowing
from stepguard.llm.common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is tested against brute force."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_html_extraction")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select(
        "page_id", "url", html_extraction.main_text(F.col("html")).alias("found")
    ).select("page_id", "url", "found.text", F.length("found.text").cast("long").alias("n_chars"))


@query("op2_secret_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, folder, "documents"))


@query("op7_winnowing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.compare_with_next(table(spark, folder, "documents"))


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.group_digest(table(spark, folder, "documents"))


@query("op8_quality_rules", quality_rules.ORACLE)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, folder, "documents"))


@query("op3_line_dedup", line_dedup.ORACLE)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(table(spark, folder, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


@query("op5_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_digest(table(spark, folder, "documents"))


@query("op4_sharding")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_digest(table(spark, folder, "documents"))


@query("op9_pieces")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.with_pieces(docs).select("doc_id", "n_tokens", "token_ids", "round_trip")


@query("op6_pitman_yor")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.score_digest(table(spark, folder, "documents"))


@query("op11_hard_negatives", hard_negatives.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.negative_digest(table(spark, folder, "embeddings"))


@query("op12_content_sort", content_sort.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.copy_digest(table(spark, folder, "documents"))


@query("op13_eigen_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return eigen_whitening.whitening_digest(table(spark, folder, "embeddings"))
