"""Isolation forest and random forest scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.operators.trees import GrownForest, grow_forest, in_blocks, mllib_trees, scorer
from stepguard.session import SMALL_TABLE_BYTES, checkpointed

EULER = 0.5772156649015329
#: Rows that a task scores, at most and where there are few.
TASK_ROWS, FEW_ROWS = 100_000, 2_000
#: Rows to fit from which a random forest grows a tree to a task.
TREE_ROWS = 100_000
#: Rows that go through all trees together.
ROWS_HELD = 256
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double, rows int"
)


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.atleast_1d(np.asarray(n, dtype=float))
    out = np.zeros(len(n))
    out[n == 2] = 1.0
    many = n > 2
    out[many] = 2.0 * (np.log(n[many] - 1.0) + EULER) - 2.0 * (n[many] - 1.0) / n[many]
    return out


def grow_tree(tree: int, rows: np.ndarray, seed: int) -> pd.DataFrame:
    """One isolation tree over a small sample, as a table of nodes."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[list] = []
    waiting = [(rows, 0, None, None)]
    while waiting:
        part, depth, parent, side = waiting.pop()
        place = len(nodes)
        if parent is not None:
            nodes[parent][side] = place
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        split = np.flatnonzero(high > low) if len(part) > 1 and depth < limit else []
        if len(split) == 0:
            nodes.append([tree, place, -1, 0.0, -1, -1, depth + expected_depth(len(part))[0], len(part)])
            continue
        feature = int(rng.choice(split))
        threshold = float(rng.uniform(low[feature], high[feature]))
        nodes.append([tree, place, feature, threshold, -1, -1, 0.0, len(part)])
        below = part[:, feature] <= threshold
        waiting.append((part[below], depth + 1, place, 4))
        waiting.append((part[~below], depth + 1, place, 5))
    return pd.DataFrame(nodes, columns=[f.split()[0] for f in NODE_SCHEMA.split(", ")])


def _uniform(*columns: str, salt: str) -> Column:
    """A uniform number in [0, 1) that depends on the row only."""
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(2**53)) / float(2**53)


def tree_samples(
    df: DataFrame, record_id: str, features: str, trees: int, sample_rows: int, seed: int
) -> DataFrame:
    """``sample_rows`` random rows for every tree, or all rows where the table has no more.

    One rule for tables of any size: a row goes to ``rate`` trees on average, one
    and a half times what the trees need, but to none of them twice. Rows are
    thinned by a hash before they are shuffled, and each task passes on the rows of
    the smallest ranks of a tree only, which merge as bottom-k sketches do. If a tree
    came out short, the rate is doubled; at the highest one every tree is offered
    all rows.
    """
    total = df.count()
    rate = min(float(trees), 1.5 * trees * sample_rows / max(total, 1))
    while True:
        drawn = checkpointed(_tree_ranks(df, record_id, features, trees, sample_rows, seed, rate))
        full = drawn.groupBy("tree").count().filter(F.col("count") >= min(sample_rows, total)).count()
        if full == trees or rate >= trees:
            return drawn
        rate = min(float(trees), 2 * rate)


def _tree_ranks(
    df: DataFrame, record_id: str, features: str, trees: int, sample_rows: int, seed: int, rate: float
) -> DataFrame:
    more = _uniform(record_id, salt=f"{seed}-keep") < rate - int(rate)
    copies = F.lit(int(rate)) + more.cast("int")
    drawn = df.select(record_id, features, copies.alias("copies")).filter("copies > 0").select(
        record_id, features, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    # The copies of a row go to different trees: they start at a random tree and step by one.
    start = F.floor(_uniform(record_id, salt=f"{seed}-tree") * trees)
    placed = drawn.select(
        ((start + F.col("copy")) % trees).cast("int").alias("tree"),
        F.struct(_uniform(record_id, "copy", salt=f"{seed}-rank"), record_id, "copy").alias("rank"),
        features,
    )
    window = Window.partitionBy("tree").orderBy("rank")
    return (
        placed.withColumn("place", F.row_number().over(window))
        .filter(F.col("place") <= sample_rows)
        .select("tree", "place", features)
    )


def fit_isolation_forest(
    df: DataFrame,
    record_id: str,
    features: str,
    trees: int = 300,
    sample_rows: int = 256,
    seed: int = 42,
) -> DataFrame:
    """Grow the trees in parallel, one task input of ``sample_rows`` rows per tree.

    The result is the node table, at most ``2 * sample_rows`` rows per tree.
    """
    samples = tree_samples(df, record_id, features, trees, sample_rows, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(pdf.sort_values("place")[features].tolist(), dtype=float)
        return grow_tree(int(pdf["tree"].iloc[0]), rows, seed)

    return checkpointed(samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA))


@dataclass
class FlatForest:
    """The nodes of all trees in a row. ``after`` has two places a node, where a row
    goes that is beyond the threshold and one that is not; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    after: np.ndarray
    path: np.ndarray
    deepest: int

    def path_sums(self, rows: np.ndarray) -> np.ndarray:
        """The path lengths of each row, added up in the order of the trees."""
        out = np.zeros(len(rows))
        if not len(self.roots):
            return out
        for first in range(0, len(rows), ROWS_HELD):
            part = rows[first : first + ROWS_HELD]
            values, start = part.ravel(), np.arange(len(part)) * part.shape[1]
            at = np.repeat(self.roots[:, None], len(part), axis=1)
            for _ in range(self.deepest):
                below = values.take(start + self.feature.take(at)) <= self.threshold.take(at)
                at = self.after.take(2 * at + below)
            out[first : first + ROWS_HELD] = np.add.reduce(self.path.take(at), axis=0)
        return out


def flat_forest(table: pd.DataFrame) -> FlatForest:
    """From the node table, ordered by tree and node."""
    here = np.arange(len(table))
    leaf = table["feature"].to_numpy() < 0
    roots = np.flatnonzero(table["node"].to_numpy() == 0)
    offset = here - table["node"].to_numpy()
    after = np.empty(2 * len(table), dtype=np.int64)
    for side, name in ((0, "right"), (1, "left")):
        after[side::2] = np.where(leaf, here, offset + table[name].to_numpy())
    deepest, level = 0, roots[~leaf[roots]]
    while len(level):
        level = np.concatenate([after[2 * level], after[2 * level + 1]])
        deepest, level = deepest + 1, level[~leaf[level]]
    feature = np.where(leaf, 0, table["feature"].to_numpy()).astype(np.int64)
    return FlatForest(roots, feature, table["threshold"].to_numpy(), after, table["path"].to_numpy(), deepest)


def spread(df: DataFrame) -> DataFrame:
    """Rows in tasks of ``TASK_ROWS`` at most on average, all cores used from a few thousand rows on."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // TASK_ROWS), min(cores, -(-rows // FEW_ROWS)), 1))


def score_isolation_forest(
    df: DataFrame, nodes: DataFrame, features: str, out: str = "score"
) -> DataFrame:
    """Anomaly score in (0, 1]; higher is more isolated.

    Depths are scaled by the rows that the trees were really grown on.
    The node table is bounded by trees and sample size, not by the data, and is
    sent to every executor once.
    """
    table = nodes.orderBy("tree", "node").toPandas()
    shared = df.sparkSession.sparkContext.broadcast(flat_forest(table))
    grown = table.loc[table["node"] == 0, "rows"]
    scale = max(float(expected_depth(grown.mean() if len(grown) else 1.0)[0]), 1e-12)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=float)
                continue
            rows = np.array(batch.tolist(), dtype=float)
            depth = shared.value.path_sums(rows)
            yield pd.Series(2.0 ** (-depth / max(len(shared.value.roots), 1) / scale))

    return spread(df).withColumn(out, score(F.col(features)))


def balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight rows so that both labels count the same: n / (2 * n_label)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("pos")
    ).select(F.struct("n", "pos")).scalar()
    table = df.withColumn("__counts", counts)
    own = F.when(F.col(label), F.col("__counts.pos")).otherwise(
        F.col("__counts.n") - F.col("__counts.pos")
    )
    return table.withColumn(out, F.col("__counts.n") / (2.0 * own)).drop("__counts")


def fit_random_forest(
    df: DataFrame,
    label: str,
    features: str,
    trees: int = 500,
    depth: int = 30,
    seed: int = 42,
) -> RandomForestClassificationModel | GrownForest:
    """Both labels weigh the same. The depth is the largest that trees can have here,
    so leaves are pure wherever the rows allow it.

    MLlib passes over all rows of all trees for each level. From ``TREE_ROWS`` rows on a
    task grows a tree, if all rows have at most ``SMALL_TABLE_BYTES`` there: a byte for
    each feature and one for the label. Both ways draw by the same law, but not the same.
    In MLlib each row keeps its node in every tree instead of going down from the root in each pass.
    """
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(features)), F.lit(0))).first()
    if rows >= TREE_ROWS and rows * (size + 1) <= SMALL_TABLE_BYTES:
        return grow_forest(df, rows, label, features, trees, depth, seed)
    weighted = balanced_weight(df, label).select(
        F.col(label).cast("double").alias("label"),
        array_to_vector(F.col(features)).alias("vector"),
        "weight",
    )
    forest = RandomForestClassifier(
        featuresCol="vector",
        labelCol="label",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=1,
        featureSubsetStrategy="sqrt",
        cacheNodeIds=True,
        seed=seed,
    )
    return forest.fit(weighted)


def score_random_forest(
    model: RandomForestClassificationModel | GrownForest, df: DataFrame, features: str, out: str = "score"
) -> DataFrame:
    """The share of the votes for the positive label.

    The nodes of all trees are sent to every executor once; blocks of rows go down tree by tree.
    """
    spark = df.sparkSession
    trees = model.trees if isinstance(model, GrownForest) else mllib_trees(spark, model)
    shared = spark.sparkContext.broadcast(scorer(trees, len(model.featureImportances)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in in_blocks(batches):
            yield pd.Series(shared.value.probabilities(rows))

    return spread(df).withColumn(out, score(F.col(features)))


def feature_importance(
    model: RandomForestClassificationModel | GrownForest, df: DataFrame, names: list[str]
) -> DataFrame:
    """Importance per feature, largest first; one row per feature of the model."""
    values = [float(v) for v in model.featureImportances.toArray()]
    rows = list(zip(names, values))
    frame = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")
