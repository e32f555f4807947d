"""Classification trees over binned features: grown a tree to a task, and scored in arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepguard.session import checkpointed, scratch_path

#: As MLlib has them: bins of a feature, and rows from which their edges are taken.
BINS, EDGE_ROWS = 32, 10_000
#: Nodes of a level whose counts are held together, and rows that walk down together.
NODES_HELD, ROWS_HELD = 16_384, 32_768
#: Nodes of a level up to which sets of rows are faster than rows that walk.
SET_NODES = 1_024
#: Less than any gain that isn't a rounding error.
NO_GAIN = 1e-15
TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
    "weights array<double>, importance array<double>"
)


def edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between the values of a feature, at most ``bins - 1``, by MLlib's rule.

    All midpoints of neighbouring values, or those next to equal shares of the rows.
    """
    found, counts = np.unique(values, return_counts=True)
    middle = (found[:-1] + found[1:]) / 2.0
    if len(middle) <= bins - 1:
        return middle
    stride = len(values) / bins
    below, chosen, target = np.cumsum(counts), [], stride
    for i in range(len(middle)):
        if abs(below[i] - target) < abs(below[i + 1] - target):
            chosen.append(middle[i])
            target += stride
    return np.array(chosen)


@dataclass
class BinnedRows:
    """Rows as the bins of their features, a line per feature, and their labels."""

    bins: np.ndarray
    positive: np.ndarray
    edges: list[np.ndarray]


def binned(rows: np.ndarray, cuts: Sequence[np.ndarray], kind) -> np.ndarray:
    """A line per feature; a value is in a bin not above ``i`` if it is not above edge ``i``. NaN is above all."""
    return np.array([np.searchsorted(cut, rows[:, f], "left") for f, cut in enumerate(cuts)], dtype=kind)


def binned_rows(df: DataFrame, total: int, label: str, features: str, seed: int) -> BinnedRows:
    """All ``total`` rows of ``df`` on the driver, in a byte for each feature and one for the label."""
    rate = max(BINS**2, EDGE_ROWS) / max(total, 1)
    sample = df.select(features) if rate >= 1 else df.select(features).sample(rate, seed)
    sample = np.array([row[0] for row in sample.collect()], dtype=float)
    cuts = [edges(sample[:, f]) for f in range(sample.shape[1])]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.array(batch.column("features").to_pylist(), dtype=float)
                if batch.column("label").null_count or not np.isfinite(rows).all():
                    raise ValueError("a row to fit has no label, or a feature that is no number")
                bins = binned(rows, cuts, np.uint8)
                positive = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_pydict(
                    {"bins": pa.array([bins.tobytes()], pa.binary()), "positive": pa.array([positive.tobytes()], pa.binary())}
                )

    parts = (
        df.select(F.col(label).alias("label"), F.col(features).alias("features"))
        .mapInArrow(packed, "bins binary, positive binary")
        .collect()
    )
    positive = [np.frombuffer(p["positive"], np.uint8) for p in parts]
    bins = [np.frombuffer(p["bins"], np.uint8).reshape(len(cuts), -1) for p in parts]
    return BinnedRows(np.concatenate(bins, axis=1), np.concatenate(positive), cuts)


def grow(rows: BinnedRows, tree: int, depth: int, seed: int) -> dict:
    """One tree over a bootstrap sample of all rows; both labels weigh the same.

    At each node the best cut of ``ceil(sqrt(n))`` random features is taken, if it gains anything.
    """
    random = np.random.default_rng([seed, tree])
    size, total = rows.bins.shape
    some = int(np.ceil(np.sqrt(size)))
    bins = rows.bins.reshape(-1)
    each = total / (2.0 * np.maximum(np.bincount(rows.positive, minlength=2), 1))
    drawn = random.poisson(1.0, total)
    row = np.flatnonzero(drawn)
    times, positive = drawn[row].astype(float), rows.positive[row].astype(np.int64)
    at = np.zeros(len(row), dtype=np.int64)
    feature, threshold, left, weights = [], [], [], []
    importance, nodes, made, level = np.zeros(size), 1, 0, 0
    while nodes:
        counts = np.bincount(2 * at + positive, times, 2 * nodes).reshape(nodes, 2)
        feature.append(np.full(nodes, -1))
        threshold.append(np.zeros(nodes))
        left.append(np.full(nodes, -1))
        weights.append(counts * each)
        made += nodes
        mixed = (counts > 0).all(axis=1) & (level < depth)
        stay = mixed[at]
        row, times, positive, at = row[stay], times[stay], positive[stay], at[stay]
        open_nodes = np.flatnonzero(mixed)
        at = (np.cumsum(mixed) - 1)[at]
        tried = random.random((len(open_nodes), size)).argsort(axis=1)[:, :some]
        gain, best, cut = _best_cuts(bins, total, row, times, positive, at, tried, each)
        split = gain > NO_GAIN
        own, parts = open_nodes[split], int(split.sum())
        feature[-1][own] = best[split]
        threshold[-1][own] = [rows.edges[f][c] for f, c in zip(best[split], cut[split], strict=True)]
        left[-1][own] = made + 2 * np.arange(parts)
        np.add.at(importance, best[split], gain[split] * weights[-1][own].sum(axis=1))
        stay = split[at]
        row, times, positive, at = row[stay], times[stay], positive[stay], at[stay]
        beyond = bins.take(best.take(at) * total + row) > cut.take(at)
        at = 2 * (np.cumsum(split) - 1)[at] + beyond
        nodes, level = 2 * parts, level + 1
    left = np.concatenate(left)
    norm = importance.sum()
    return {
        "tree": tree, "feature": np.concatenate(feature), "threshold": np.concatenate(threshold), "left": left,
        "right": np.where(left < 0, -1, left + 1), "weights": np.concatenate(weights).ravel(),
        "importance": importance / norm if norm else importance,
    }


def _best_cuts(bins, total, row, times, positive, at, tried, each) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest gain of each node among the features it tries, with the feature and the last bin below."""
    nodes = len(tried)
    gain, best, cut = np.zeros(nodes), np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    for first in range(0, nodes, NODES_HELD):
        held = min(NODES_HELD, nodes - first)
        if nodes > NODES_HELD:
            here = np.flatnonzero((at >= first) & (at < first + held))
            r, t, p, a = row[here], times[here], positive[here], at[here] - first
        else:
            r, t, p, a = row, times, positive, at
        for j in range(tried.shape[1]):
            f = tried[first : first + held, j]
            cell = 2 * (a * BINS + bins.take(f.take(a) * total + r)) + p
            # whole numbers, so the rest of a node is exactly nothing or something
            below = np.bincount(cell, t, held * BINS * 2).reshape(held, BINS, 2).cumsum(axis=1)
            whole = below[:, -1:] * each
            under = below[:, :-1] * each
            over = (below[:, -1:] - below[:, :-1]) * each
            found = _impurity(whole) - (_share(under, whole) + _share(over, whole))
            found[(under.sum(axis=2) == 0) | (over.sum(axis=2) == 0)] = -1.0
            at_best = found.argmax(axis=1)
            most = found[np.arange(held), at_best]
            better = np.flatnonzero(most > gain[first : first + held])
            gain[first + better], best[first + better], cut[first + better] = most[better], f[better], at_best[better]
    return gain, best, cut


def _impurity(weights: np.ndarray) -> np.ndarray:
    total = weights.sum(axis=-1)
    return 1.0 - (weights**2).sum(axis=-1) / np.maximum(total, 1e-100) ** 2


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part.sum(axis=-1) / whole.sum(axis=-1) * _impurity(part)


@dataclass
class Level:
    """The nodes of a level, in the order of their parents: all children below a cut, then all beyond."""

    inner: np.ndarray  # places of the nodes that are cut, and their cuts' places among all
    cuts: np.ndarray
    sure: np.ndarray  # places of leaves where all votes are for the second label
    unsure: np.ndarray  # places of leaves with votes for both, and a line of them for each label
    votes: np.ndarray


@dataclass
class Tree:
    """Nodes of a tree: a leaf leads to itself. ``after`` has the node beyond the cut and the one below."""

    feature: np.ndarray
    cut: np.ndarray
    after: np.ndarray
    leaf: np.ndarray
    votes: np.ndarray  # a line per label
    levels: list[Level]  # down to the first with more than ``SET_NODES`` nodes
    rest: np.ndarray  # the nodes of that one

    def ends(self, bins: np.ndarray, rows: int, under: np.ndarray, everyone: np.ndarray) -> np.ndarray:
        """The votes of the leaf of each row, a line per label.

        In ``levels`` by the sets of rows that reach each node, a bit for each row;
        rows that are left walk down.
        """
        here, sure = everyone, np.zeros(len(everyone[0]), dtype=np.uint64)
        both = []
        for level in self.levels:
            if len(level.sure):
                sure |= np.bitwise_or.reduce(here.take(level.sure, axis=0), axis=0)
            if len(level.unsure):
                leaf, row = _members(here.take(level.unsure, axis=0))
                both.append((row, level.votes[:, leaf]))
            parents = here.take(level.inner, axis=0)
            below = parents & under.take(level.cuts, axis=0)
            here = np.concatenate([below, parents ^ below])
        if len(self.rest):
            node, row = _members(here)
            both.append((row, self.votes[:, self.walked(bins, rows, row, self.rest[node])]))
        out = np.empty((2, rows))
        out[1] = np.unpackbits(sure.view(np.uint8), bitorder="little", count=rows)
        out[0] = 1.0 - out[1]
        for row, votes in both:
            out[0][row], out[1][row] = votes
        return out

    def walked(self, bins: np.ndarray, rows: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf that each of ``row`` gets to, from the node it is at."""
        end, place = np.empty(len(row), dtype=np.int64), np.arange(len(row))
        while len(row):
            done = self.leaf.take(at)
            # rows that have ended wait until they are worth sorting out
            if 8 * np.count_nonzero(done) >= len(row):
                end[place[done]] = at[done]
                on = np.flatnonzero(~done)
                place, row, at = place.take(on), row.take(on), at.take(on)
            below = bins.take(self.feature.take(at) * rows + row) <= self.cut.take(at)
            at = self.after.take(2 * at + below)
        return end


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets, a line for each, as pairs of a set's place and a row in it."""
    held = sets.view(np.uint8)
    own, byte = np.nonzero(held)
    some, bit = np.nonzero(np.unpackbits(held[own, byte][:, None], axis=1, bitorder="little"))
    return own[some], byte[some] * 8 + bit


def _levels(
    feature: np.ndarray, place: np.ndarray, after: np.ndarray, votes: np.ndarray
) -> tuple[list[Level], np.ndarray]:
    levels, nodes = [], np.zeros(1, dtype=np.int64)
    while 0 < len(nodes) <= SET_NODES:
        leaf = feature[nodes] < 0
        inner = np.flatnonzero(~leaf)
        sure = np.flatnonzero(leaf & (votes[0, nodes] == 0.0) & (votes[1, nodes] == 1.0))
        unsure = np.flatnonzero(leaf & (votes[0, nodes] != 0.0) & (votes[1, nodes] != 0.0))
        levels.append(Level(inner, place[nodes[inner]], sure, unsure, votes[:, nodes[unsure]]))
        nodes = np.concatenate([after[2 * nodes[inner] + 1], after[2 * nodes[inner]]])
    return levels, nodes


@dataclass
class Scorer:
    """All trees, with thresholds as places among those of their feature."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """The votes for the second label, of all votes, added up in the order of the trees."""
        kind = np.uint8 if max(map(len, self.edges), default=0) < 256 else np.int32
        out = np.zeros(len(rows))
        for first in range(0, len(rows), ROWS_HELD):
            part = rows[first : first + ROWS_HELD]
            bins = binned(part, self.edges, kind)
            padded = np.zeros((len(self.edges), -(-len(part) // 64) * 64), dtype=kind)
            padded[:, : len(part)] = bins
            under = np.zeros((1 + sum(map(len, self.edges)), padded.shape[1]), dtype=bool)
            under[0, : len(part)] = True  # everyone
            at = 1
            for line, cuts in zip(padded, self.edges, strict=True):
                np.less_equal(line, np.arange(len(cuts))[:, None], out=under[at : at + len(cuts)])
                at += len(cuts)
            under = np.packbits(under, axis=1, bitorder="little").view(np.uint64)
            bins = bins.reshape(-1)
            votes = np.zeros((2, len(part)))
            for tree in self.trees:
                votes += tree.ends(bins, len(part), under[1:], under[:1])
            out[first : first + ROWS_HELD] = votes[1] / (votes[0] + votes[1])
        return out


def scorer(trees: Sequence[dict], size: int) -> Scorer:
    """From the nodes of each tree, in order, as :func:`grow` gives them."""
    found = Scorer()
    inner = [np.asarray(t["feature"], dtype=np.int64) for t in trees]
    values = [np.asarray(t["threshold"], dtype=float) for t in trees]
    for f in range(size):
        own = [np.unique(v[i == f]) for i, v in zip(inner, values, strict=True)]
        found.edges.append(np.unique(np.concatenate([np.zeros(0), *own])))
    first = np.cumsum([0, *map(len, found.edges)])
    for tree, feature, threshold in zip(trees, inner, values, strict=True):
        leaf, here = feature < 0, np.arange(len(feature))
        after = np.empty(2 * len(feature), dtype=np.int64)
        after[0::2] = np.where(leaf, here, np.asarray(tree["right"], dtype=np.int64))
        after[1::2] = np.where(leaf, here, np.asarray(tree["left"], dtype=np.int64))
        cut = np.zeros(len(feature), dtype=np.int64)
        for f in range(size):
            own = feature == f
            cut[own] = np.searchsorted(found.edges[f], threshold[own])
        weights = np.asarray(tree["weights"], dtype=float).reshape(-1, 2)
        votes = np.ascontiguousarray((weights / weights.sum(axis=1, keepdims=True)).T)
        levels, rest = _levels(feature, first[feature] + cut, after, votes)
        found.trees.append(Tree(np.where(leaf, 0, feature), cut, after, leaf, votes, levels, rest))
    return found


@dataclass
class GrownForest:
    """A forest of :func:`grow_forest`."""

    trees: list[dict]
    featureImportances: DenseVector  # noqa: N815, as MLlib's models name it

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.trees)


def grow_forest(
    df: DataFrame, total: int, label: str, features: str, trees: int, depth: int, seed: int
) -> GrownForest:
    """A task for each tree. Each has all rows, in a byte for each feature and one for the label."""
    spark = df.sparkSession
    rows = binned_rows(df, total, label, features, seed)
    shared, size = spark.sparkContext.broadcast(rows), len(rows.edges)

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                yield pd.DataFrame([grow(shared.value, int(tree), depth, seed)])

    found = checkpointed(spark.range(0, trees, 1, trees).mapInPandas(grown, TREE_SCHEMA))
    shared.unpersist()
    nodes = found.orderBy("tree").toPandas().to_dict("records")
    importance = np.sum([t["importance"] for t in nodes], axis=0) if nodes else np.zeros(size)
    return GrownForest(nodes, Vectors.dense(importance / (importance.sum() or 1.0)))


def in_blocks(batches: Iterator[pd.Series]) -> Iterator[np.ndarray]:
    """Batches of feature vectors put together to blocks of some ``ROWS_HELD`` rows."""
    held, rows = [], 0
    for batch in batches:
        if len(batch):
            held.append(np.array(batch.tolist(), dtype=float))
            rows += len(batch)
        if rows >= ROWS_HELD:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def mllib_trees(spark: SparkSession, model) -> list[dict]:
    """The nodes of a forest of MLlib, as :func:`grow` gives them."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    node = F.col("nodeData")
    table = (
        spark.read.parquet(f"{path}/data")
        .select(
            F.col("treeID").alias("tree"),
            node["id"].alias("node"),
            node["split"]["featureIndex"].alias("feature"),
            F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
            node["leftChild"].alias("left"),
            node["rightChild"].alias("right"),
            node["impurityStats"][0].alias("w0"),
            node["impurityStats"][1].alias("w1"),
        )
        .toPandas()
        .sort_values(["tree", "node"])
    )
    return [
        {name: part[name].to_numpy() for name in ("feature", "threshold", "left", "right")}
        | {"weights": part[["w0", "w1"]].to_numpy().ravel()}
        for _, part in table.groupby("tree")
    ]
