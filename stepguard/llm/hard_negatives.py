"""Hard negatives of anchors by Fagin's threshold algorithm.

Vectors are quantised to whole numbers, ``floor(256 * x)``, and a score is the exact
inner product with the anchor. Candidates are dealt to blocks of ``BLOCK`` rows,
anchors to blocks of ``ANCHORS``; each pair of blocks is one task's work, so what
a task holds is bounded for any input. In a block every dimension has a list of the
candidates sorted by their value. An anchor reads the lists from the top where its
own value is positive and from the bottom where it is negative, in steps of growing
depth. A candidate seen for the first time in any list gets its score by random
access to its whole vector. What is not seen yet scores no more than the threshold,
the score of the values that the lists have come to. A window (a range of scores with
the labels it takes) is done once the threshold is strictly below its kth best score,
or below its lower end; the search ends when all windows are done or all is seen.

It runs twice: for the first ``POSITIVES`` rows of the anchor's own label, then for the
windows that follow from these positives' scores. The best of each block are merged by
a ranking that keeps k rows per partition before the shuffle.

Rows with a null label, a null vector or null or non-finite components take no part,
nor do rows without an id, which nothing could name. Only vectors of equal length are
compared. Ids may repeat. A row equal to the anchor in id, label and vector is the anchor
stored again and not another row; a row with its id and another label or vector is one.
Repeated rows count as often as they stand in the table, as anchors, positives and
negatives. An anchor
without positives, or with windows that nothing falls into, gives no rows. Scores
beyond 63 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.session import checkpointed

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: Bounds of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
BLOCK = 4096
ANCHORS = 4096
FIRST_DEPTH = 8
EVERYTHING = 2**63 - 1


def _largest(values: np.ndarray) -> int:
    """The largest absolute value; that of the smallest whole number fits as well."""
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


class Lists:
    """The candidates of a block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], np.ascontiguousarray(vectors[order])
        self.largest = _largest(self.vectors)
        self.descending = np.argsort(-self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.descending, axis=1)

    def rounds(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """New positions, their scores, and the threshold for what is not seen (None: all is seen)."""
        n = len(self.ids)
        if len(anchor) * self.largest * _largest(anchor) >= 2**63:
            raise OverflowError("scores don't fit in 63 bits")
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) + len(down):  # no list says anything: every score is zero
            yield np.arange(n), np.zeros(n, dtype=np.int64), None
            return
        seen, left, depth, done = np.zeros(n, dtype=bool), n, FIRST_DEPTH, 0
        while left:
            depth = min(depth, n)
            reached = np.zeros(n, dtype=bool)
            reached[self.descending[up, done:depth].ravel()] = True
            reached[self.descending[down, n - depth : n - done].ravel()] = True
            new = np.flatnonzero(reached & ~seen)
            seen[new] = True
            left -= len(new)
            threshold = int(anchor[up] @ self.values[up, depth - 1]) + int(anchor[down] @ self.values[down, n - depth])
            yield new, self.vectors[new] @ anchor, threshold if left else None
            done, depth = depth, depth * 4


def search(
    lists: Lists, anchor: np.ndarray, own_id: int, label: int, same: bool, bounds: list[tuple[int, int]], k: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each range of scores the ids and scores of its k best rows, and the number of rows seen.

    ``same`` takes rows of the anchor's label, else all others. The best come first,
    of equal scores the smaller ids.
    """
    found, held, seen = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    top, open_windows = [(found, held)] * len(bounds), list(range(len(bounds)))
    for new, scores, threshold in lists.rounds(anchor):
        seen += len(new)
        fits = (lists.labels[new] == label) == same
        if same:  # the anchor itself, however often it is stored
            fits &= (lists.ids[new] != own_id) | (lists.vectors[new] != anchor).any(axis=1)
        found, held = np.concatenate([found, new[fits]]), np.concatenate([held, scores[fits]])
        order = np.lexsort((found, -held))  # positions are in the order of ids
        found, held = found[order], held[order]
        for w in list(open_windows):
            low, high = bounds[w]
            start = int(np.searchsorted(-held, -high, side="left"))
            end = min(int(np.searchsorted(-held, -low, side="right")), start + k)
            top[w] = (lists.ids[found[start:end]], held[start:end])
            if threshold is not None and (threshold < low or (end - start == k and threshold < int(held[end - 1]))):
                open_windows.remove(w)
        if not open_windows:
            break
    return top, seen


def score_bounds(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score; empty where the first is larger."""
    return -(-low * score // 100), high * score // 100


def _lists(rows: pd.DataFrame) -> Lists:
    vectors = np.stack(rows["vector"].to_list()).astype(np.int64)
    return Lists(rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), vectors)


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    parts = []
    if len(anchors) and len(rows):
        lists = _lists(rows)
        for uid, key, label, vector in zip(*[anchors[c] for c in ("uid", "id", "label", "vector")], strict=True):
            [(ids, scores)], _ = search(lists, np.asarray(vector, np.int64), key, label, True, [(-EVERYTHING, EVERYTHING)], k)
            parts.append(pd.DataFrame({"uid": uid, "id": ids, "score": scores}))
    return pd.concat(parts) if parts else pd.DataFrame({"uid": [], "id": [], "score": []}, dtype="int64")


def _negatives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    parts = []
    if len(anchors) and len(rows):
        lists = _lists(rows)
        columns = [anchors[c] for c in ("uid", "id", "label", "vector", "scores")]
        for uid, key, label, vector, scores in zip(*columns, strict=True):
            bounds = {n: score_bounds(int(s), low, high) for n, s in enumerate(scores, 1)}
            bounds = {n: b for n, b in bounds.items() if b[0] <= b[1]}
            if bounds:
                top, _ = search(lists, np.asarray(vector, np.int64), key, label, False, list(bounds.values()), k)
                for n, (ids, found) in zip(bounds, top, strict=True):
                    parts.append(pd.DataFrame({"uid": uid, "place": n, "id": ids, "score": found}))
    empty = pd.DataFrame({"uid": [], "place": [], "id": [], "score": []}, dtype="int64")
    return pd.concat(parts) if parts else empty


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    infinite = F.lit(float("inf"))
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)), F.lit(False)
    )


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = BLOCK,
    anchor_block: int = ANCHORS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on the columns of ``rows``.
    """
    vector = F.col(f"`{vector_col}`")
    taken = checkpointed(
        rows.filter(usable(vector) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).select(
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.col(f"`{label_col}`").cast("long").alias("label"),
            quantised(vector).alias("vector"),
            F.size(vector).alias("length"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    n, asking = taken.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, anchor_blocks = max(1, -(-n // block)), max(1, -(-asking // anchor_block))
    dealt = F.xxhash64("uid")
    cell = ["length", "rows_at", "anchors_at"]
    renamed = [F.col(c).alias(c) for c in ("id", "label", "vector", "length")]  # both sides come from one table
    candidates = taken.select(
        *renamed, F.pmod(dealt, F.lit(blocks)).alias("rows_at"),
        F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("anchors_at"),
    ).groupBy(cell)
    anchors = taken.filter("asks").select("uid", "id", "label", "vector", "length", F.pmod(dealt, F.lit(anchor_blocks)).alias("anchors_at"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rows_at")
    best_first = [F.desc("score"), F.asc("id")]

    first = (
        anchors.select("*", every_block)
        .groupBy(cell)
        .cogroup(candidates)
        .applyInPandas(lambda a, c: _positives(a, c, positives), "uid long, id long, score long")
        .withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy(best_first)))
        .filter(F.col("place") <= positives)
    )
    first = checkpointed(first.select("uid", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    told = first.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("found"))
    asked = anchors.join(told, "uid").select(anchors["*"], F.col("found.positive_score").alias("scores"), every_block)
    ranked = (
        asked.groupBy(cell)
        .cogroup(candidates)
        .applyInPandas(
            lambda a, c: _negatives(a, c, negatives, low, high), "uid long, place int, id long, score long"
        )
        .withColumn("rank", F.row_number().over(Window.partitionBy("uid", "place").orderBy(best_first)))
        .filter(F.col("rank") <= negatives)
    )
    return (
        ranked.join(first, ["uid", "place"])
        .join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
        .select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def negative_digest(rows: DataFrame) -> DataFrame:
    """The columns of the registered query: every hundredth id asks, labels of every seventh are moved."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    asked = rows.select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(asked, F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH q AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id) AS place FROM s WHERE same
  QUALIFY place <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id,
  (row_number() OVER (PARTITION BY p.uid, p.place ORDER BY s.score DESC, s.id))::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
