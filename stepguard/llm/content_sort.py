"""Exact copies of texts by a sort of their content.

Texts are equal when their bytes are equal after A to Z went to lower case; null
counts as empty. Every row is dealt to a range of the normalised bytes, whose
splitters Spark samples, and sorted there by the whole bytes, on disk where a range
doesn't fit in memory. Equal texts become neighbours, and a run of neighbours that
are equal in full is a group. Splitters compare the first ``LEAD`` characters, then
a hash of the whole text, so a passage that many texts begin with is dealt over
many ranges and no whole texts are sampled to the driver. A text moves once.

A group that holds more than a hundred-thousandth of all rows or bytes (and no
fewer than ``HOT_ROWS`` or ``HOT_BYTES``) is cut into pieces of that size, each a
run of its own in a range of its own. The heads of such pieces are compared in full
once more. By that rule there are 200,000 cut hashes at most, for any input, so
the table of them is broadcast. They are known from counts per hash over all rows.

Of a group the row with the smallest identifier stays, or with the largest
(``keep``). A null identifier stays only where the group has no other. Of rows
that are equal in identifier and text exactly one stays. An empty table gives
no rows. Columns of the input whose names clash with the added ones give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.session import checkpointed

LEAD = 32
HOT_ROWS = 5_000
HOT_BYTES = 64 * 1024 * 1024
#: A group is cut when it holds more than this part of all rows or bytes.
HOT_SHARE = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def hot_hashes(texts: DataFrame, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``hash`` and the number of ``pieces`` of every text hash with too many rows or bytes.

    ``texts`` has one column of normalised texts.
    """
    text = F.col(texts.columns[0])
    counted = checkpointed(
        texts.select(F.xxhash64(text).alias("hash"), F.octet_length(text).cast("long").alias("size"))
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"))
        .filter("n > 1")
    )
    # no sum of all rows is needed: rows that have no copy only raise the limit
    rows, held = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0))).first()
    row_limit = max(hot_rows, -(-rows // HOT_SHARE))
    byte_limit = max(hot_bytes, -(-held // HOT_SHARE))
    pieces = F.greatest(F.ceil(F.col("n") / row_limit), F.ceil(F.col("held") / byte_limit))
    return counted.select("hash", F.least(pieces, "n").cast("long").alias("pieces")).filter("pieces > 1")


def marked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    carried: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``carried`` names the columns of the input to return (all, if not given); texts
    travel once either way.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    names = docs.columns if carried is None else carried
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    hot = hot_hashes(rows.select(normalised(F.col("text"))), hot_rows, hot_bytes)
    norm = normalised(F.col("text"))
    dealt = (
        rows.withColumns({"lead": F.substring(norm, 1, LEAD), "hash": F.xxhash64(norm), "at": F.monotonically_increasing_id()})
        .join(F.broadcast(hot), "hash", "left")
        .withColumn("piece", F.coalesce(F.expr("pmod(xxhash64(at), pieces)"), F.lit(0)))
        .select("row", "id", "text", "lead", "hash", "piece", F.col("pieces").isNotNull().alias("cut"))
        .repartitionByRange("lead", "hash", "piece")
    )
    # the ranges are those of the window's keys: it adds a sort in place, no exchange
    best = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    run = Window.partitionBy("lead", "hash", "piece", "norm")
    runs = (
        dealt.withColumn("norm", norm)
        .withColumn("place", F.row_number().over(run.orderBy(best)))
        .withColumns(
            {"best": (F.min if keep == "smallest" else F.max)("id").over(run), "n": F.count(F.lit(1)).over(run)}
        )
        .select(
            "row", "id", "place", "best", "n", "cut", "piece", F.sha2("norm", 256).alias("digest"),
            F.when(F.col("cut") & (F.col("place") == 1), F.col("norm")).alias("head"),
        )
    )
    stored = checkpointed(runs)
    # the heads of cut groups: a row per piece, compared in full
    first = F.min_by if keep == "smallest" else F.max_by
    heads = stored.filter("head is not null")
    whole = (
        heads.groupBy("head")
        .agg(
            F.first("digest").alias("digest"),
            (F.min if keep == "smallest" else F.max)("best").alias("whole_best"),
            F.sum("n").alias("whole_n"),
            F.coalesce(
                first("piece", F.when(F.col("best").isNotNull(), F.struct("best", "piece"))), F.min("piece")
            ).alias("whole_piece"),
        )
        .select("digest", "whole_best", "whole_n", "whole_piece")
    )
    told = stored.join(F.broadcast(whole), "digest", "left")
    alone = F.col("whole_n").isNull()
    added = {
        "keep_id": F.when(alone, F.col("best")).otherwise(F.col("whole_best")),
        "group_size": F.coalesce("whole_n", "n"),
        "kept": (F.col("place") == 1) & (alone | (F.col("piece") == F.col("whole_piece"))),
        "text_sha256": F.col("digest"),
    }
    clash = {name.lower() for name in added}
    kept = [F.col(f"row.`{c}`").alias(c) for c in names if c.lower() not in clash]
    return told.select(*kept, *[column.alias(name) for name, column in added.items()])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **limits: int) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    found = marked(docs.select(F.struct("*").alias("doc"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")),
                   "i", "t", keep, ["doc"], **limits)
    return found.filter("kept").select("doc.*")


def copy_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query: the largest id of a group stays."""
    return marked(docs, keep="largest", carried=["doc_id"]).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""
