"""Shards of near-equal bytes for groups that stay together.

Documents with equal texts form a group, and a group goes to one shard. The groups
are dealt by Karmarkar-Karp differencing: every group starts as a partial partition
(its bytes in the first of the shards, nothing in the others), and the two partial
partitions with the largest spread are combined again and again, the fullest part
of the one with the emptiest of the other, until one is left.

Done in one place this would hold all groups in one task. So groups are dealt by a
hash to buckets of about ``BUCKET_GROUPS``, each of which is differenced on its own;
the partial partitions of the buckets (one number per shard) are differenced among
themselves in the same way, ``FAN`` at a time, level by level, until one is left.
Only tables with one row per bucket and shard lie between the levels.

A group larger than a shard's even part fills its shard alone; the rest is balanced
among the others as far as possible. Null text is empty text.
The law is ``bytes``: a document's shard depends on all documents.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.session import broadcast_if_small, checkpointed

SHARDS = 24
OVERHEAD = 8
BUCKET_GROUPS = 20_000
FAN = 512
SLOT_ROWS = 500


def differenced(sums: np.ndarray) -> np.ndarray:
    """For each row of part sums, the label that each of its parts gets.

    Rows are partial partitions with the same number of parts; a row's parts get
    different labels. Ties are decided by the order of the rows.
    """
    rows, parts = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    held = [sums[i][order[i]] for i in range(rows)]
    heap = [(-(int(h[0]) - int(h[-1])), i) for i, h in enumerate(held)]
    heapq.heapify(heap)
    left, right, turned = [], [], []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = held[a] + held[b][::-1]
        turn = np.argsort(-total, kind="stable")
        total = total[turn]
        held[a] = held[b] = None
        left.append(a)
        right.append(b)
        turned.append(turn.astype(np.int16))
        held.append(total)
        heapq.heappush(heap, (-(int(total[0]) - int(total[-1])), len(held) - 1))
    labels: list = [None] * len(held)
    if rows:
        labels[-1] = np.arange(parts, dtype=np.int16)
    for node in range(len(held) - 1, rows - 1, -1):
        turn, mine = turned[node - rows], labels[node]
        one = np.empty(parts, dtype=np.int16)
        one[turn] = mine
        labels[left[node - rows]] = one
        labels[right[node - rows]] = one[::-1]
        labels[node] = None
    out = np.empty((rows, parts), dtype=np.int16)
    for i in range(rows):
        out[i][order[i]] = labels[i]
    return out


def _dealt_groups(shards: int):
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        sums = np.zeros((len(rows), shards), dtype=np.int64)
        sums[:, 0] = rows["bytes"]
        return rows.assign(part=differenced(sums)[:, 0].astype(np.int32))[["key", "bytes", "bucket", "part"]]

    return deal


def _dealt_buckets(shards: int):
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        buckets = np.sort(rows["bucket"].unique())
        place = np.searchsorted(buckets, rows["bucket"])
        sums = np.zeros((len(buckets), shards), dtype=np.int64)
        sums[place, rows["part"]] = rows["bytes"]
        labels = differenced(sums)
        return pd.DataFrame(
            {
                "bucket": np.repeat(buckets, shards),
                "part": np.tile(np.arange(shards, dtype=np.int32), len(buckets)),
                "to_bucket": np.int64(rows["to_bucket"].iloc[0]),
                "to_part": labels.reshape(-1).astype(np.int32),
            }
        )

    return deal


def group_shards(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``key`` and ``shard`` for rows of ``key`` and ``bytes`` (one row per key)."""
    count = groups.count()
    buckets = max(1, -(-count // BUCKET_GROUPS))
    dealt = checkpointed(
        groups.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(_dealt_groups(shards), "key binary, bytes bigint, bucket bigint, part int")
    )
    sums = dealt.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    where = None
    while buckets > 1:
        buckets = -(-buckets // FAN)
        moves = checkpointed(
            sums.withColumn("to_bucket", F.pmod(F.col("bucket"), F.lit(buckets)))
            .groupBy("to_bucket")
            .applyInPandas(_dealt_buckets(shards), "bucket bigint, part int, to_bucket bigint, to_part int")
        )
        to = [F.col("to_bucket").alias("bucket"), F.col("to_part").alias("part")]
        sums = sums.join(moves, ["bucket", "part"]).select(*to, "bytes").groupBy("bucket", "part").agg(
            F.sum("bytes").alias("bytes")
        )
        if where is None:
            where = moves
        else:
            step = moves.select(
                F.col("bucket").alias("to_bucket"), F.col("part").alias("to_part"),
                F.col("to_bucket").alias("next_bucket"), F.col("to_part").alias("next_part"),
            )
            where = checkpointed(
                where.join(step, ["to_bucket", "to_part"]).select(
                    "bucket", "part", F.col("next_bucket").alias("to_bucket"), F.col("next_part").alias("to_part")
                )
            )
    if where is None:
        return dealt.select("key", F.col("part").alias("shard"))
    return dealt.join(broadcast_if_small(where), ["bucket", "part"]).select("key", F.col("to_part").alias("shard"))


def numbered(rows: DataFrame, shard: str, order: list[str | Column]) -> DataFrame:
    """Add ``slot``, a gapless number from zero within each shard.

    Rows of a shard are dealt by a hash of the ordering columns to pieces of about
    ``SLOT_ROWS``, numbered within the piece, and moved by the rows of the pieces before.
    """
    count = rows.count()
    pieces = max(1, -(-count // (SLOT_ROWS * SHARDS)))
    split = rows.withColumn("piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    sizes = split.groupBy(shard, "piece").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(shard).orderBy("piece")) - F.col("rows")
    starts = broadcast_if_small(sizes.select(shard, "piece", before.alias("start")))
    place = F.row_number().over(Window.partitionBy(shard, "piece").orderBy(*order))
    return (
        split.withColumn("place", place)
        .join(starts, [shard, "piece"])
        .withColumn("slot", F.col("start") + F.col("place") - 1)
        .drop("piece", "place", "start")
    )


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS
) -> DataFrame:
    """``id``, ``size``, ``crc``, ``shard`` and ``slot`` for every document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sized = checkpointed(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.unhex(F.md5(text)).alias("key"),
        )
    )
    groups = checkpointed(sized.groupBy("key").agg(F.sum("size").alias("bytes")))
    placed = checkpointed(sized.join(group_shards(groups, shards), "key"))
    return numbered(placed, "shard", ["id", "crc", "size"]).drop("key")


def shard_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return shard_documents(docs).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
