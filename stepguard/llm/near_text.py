"""Near copies of texts: five-word shingles with Jaccard similarity of 0.8 or more.

A text is the set of the 64-bit hashes of its five-word shingles, A to Z in lower
case; a shorter text is one shingle. Texts that may be similar come from SimHash as in
``simhash``: fingerprints that differ in two bits or fewer link, found by BK-trees in
shards, and what links connect is one bucket. Most pairs at 0.8 differ in more bits (some
13 of 64), which no shard by common bits narrows down; for these there are MinHash
buckets beside it, ``BANDS`` per text, each named by ``ROWS`` minima. A pair at 0.8 shares
no such bucket with a chance of ``(1 - 0.8 ** ROWS) ** BANDS`` (2 in a million), a more
similar one with less.

No pairs are formed of the members of a bucket: each is linked to the bucket's smallest
member, and what these links connect is a cluster. All similar pairs lie inside of
clusters. The texts of a cluster meet in one task, each once, and their sets are
compared there, exactly and all with all, by counting common shingles: rare ones by
their postings, frequent ones by a product of incidence matrices. Only a forest of the
pairs found leaves the task, fewer links than texts. A cluster of more than ``BLOCK``
texts or ``BLOCK_SHINGLES`` shingles is cut into blocks, and each pair of blocks is a
task's work: a text is then sent as often as its cluster has blocks, so what travels
grows with the square of a cluster only beyond a thousand texts and by a thousandth.

Null and empty texts are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.llm import simhash
from stepguard.llm.common import lowered_words, mixed, text_slices
from stepguard.llm.components import components
from stepguard.session import broadcast_if_small, checkpointed

WORDS = 5
SEED = 42
ROWS, BANDS = 7, 55
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Shingles whose minima are taken at a time.
SHINGLES = 1 << 12
#: Shingles in more texts than this are counted by matrix products, ``COLUMNS`` at a time.
RARE, COLUMNS = 16, 4096
FACTORS = (mixed(np.arange(1, ROWS * BANDS + 1), 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = lowered_words(text)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[WORDS - 1 :].tolist()
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends, strict=False)]
    return np.unique(np.array(hashes, dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of the orders; half a hash is enough to order by."""
    halves = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.full(len(FACTORS), 2**32 - 1, dtype=np.uint32)
    for first in range(0, len(halves), SHINGLES):
        part = halves[first : first + SHINGLES, None] * FACTORS[None, :]
        np.minimum(found, part.min(axis=0), out=found)
    return found


def buckets(rows: np.ndarray) -> np.ndarray:
    """The names of the buckets of each row of minima; no two bands share one."""
    bands = rows.astype(np.uint64).reshape(len(rows), BANDS, ROWS)
    named = np.broadcast_to(mixed(np.arange(BANDS), 12), (len(rows), BANDS)).copy()
    for place in range(ROWS):
        named = mixed(named ^ bands[:, :, place])
    return named.view(np.int64)


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(b" ".join(lowered_words(text)), SEED + 1)


def sketch(text: Column) -> Column:
    """``key`` (equal for texts of equal words), ``size`` of the set, ``buckets`` and the SimHash ``print``.

    Marked as not deterministic only to keep the optimizer from evaluating it twice.
    """

    @F.pandas_udf("key bigint, size bigint, buckets array<bigint>, print bigint")
    def found(batch: pd.Series) -> pd.DataFrame:
        keys, sizes, rows, prints = [], [], [], []
        for _, part in text_slices(batch):
            for text in part:
                hashes = shingles(text)
                keys.append(_key(text))
                sizes.append(len(hashes))
                rows.append(minima(hashes))
                prints.append(simhash.simhash(text))
        named = buckets(np.array(rows, dtype=np.uint32).reshape(-1, len(FACTORS)))
        return pd.DataFrame(
            {
                "key": np.array(keys, dtype=np.uint64).view(np.int64),
                "size": np.array(sizes, dtype=np.int64),
                "buckets": pd.Series(list(named), dtype=object),
                "print": np.array(prints, dtype=np.uint64).view(np.int64),
            }
        )

    return found.asNondeterministic()(text)


def key_of(text: Column) -> Column:
    """The key alone."""

    @F.pandas_udf("bigint")
    def hashed(batch: pd.Series) -> pd.Series:
        found = [_key(text) for _, part in text_slices(batch) for text in part]
        return pd.Series(np.array(found, dtype=np.uint64).view(np.int64))

    return hashed.asNondeterministic()(text)


# --- comparing sets in a task -------------------------------------------------------


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, above the diagonal."""
    n = len(sets)
    joined = np.concatenate(sets)
    order = np.argsort(joined, kind="stable")
    owner, joined = np.repeat(np.arange(n), [len(s) for s in sets])[order], joined[order]
    starts = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))
    held = np.diff(np.append(starts, len(joined)))
    places = [np.empty(0, dtype=np.int64)]
    for many in range(2, min(RARE, n) + 1):
        posting = owner[starts[held == many][:, None] + np.arange(many)]  # owners ascend
        first, second = np.triu_indices(many, 1)
        places.append((posting[:, first] * n + posting[:, second]).ravel())
    counts = np.bincount(np.concatenate(places), minlength=n * n).reshape(n, n)
    frequent = np.flatnonzero(held > RARE)
    for first in range(0, len(frequent), COLUMNS):
        part = frequent[first : first + COLUMNS]
        rows = np.zeros((n, len(part)), dtype=np.float32)
        at = np.concatenate([np.arange(starts[c], starts[c] + held[c]) for c in part])
        rows[owner[at], np.repeat(np.arange(len(part)), held[part])] = 1
        counts += np.triu(rows @ rows.T, 1).astype(counts.dtype)
    return counts


def similar_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest that joins all sets whose Jaccard similarity is 0.8 or more."""
    if len(sets) == 2:
        counts = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]])
    else:
        counts = common_counts(sets)
    sizes = np.array([len(s) for s in sets])
    root, pairs = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in np.argwhere(9 * counts >= 4 * (sizes[:, None] + sizes[None, :])).tolist():
        one, other = find(a), find(b)
        if one != other:
            root[one] = other
            pairs.append((a, b))
    return pairs


def _cell_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each cell; the rows of a cell follow one another."""
    cell, sets = None, {}

    def links() -> list[tuple[int, int]]:
        keys = list(sets)
        return [(keys[i], keys[j]) for i, j in similar_pairs(list(sets.values()))] if len(sets) > 1 else []

    def frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
        both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    for batch in batches:
        pairs = []
        columns = [batch[c].tolist() for c in ("cluster", "x", "y", "key", "text")]
        for *here, key, text in zip(*columns, strict=True):
            if here != cell:
                pairs += links()
                cell, sets = here, {}
            if key not in sets:
                sets[key] = shingles(text or "")
        yield frame(pairs)
    yield frame(links())


def print_buckets(sketches: DataFrame) -> DataFrame:
    """``key`` and ``bucket``: one bucket for all whose fingerprints links connect."""
    linked = components(simhash.near_links(sketches.select("print").distinct()))
    root = F.coalesce("component", "print")
    return sketches.join(linked.withColumnRenamed("node", "print"), "print", "left").select(
        "key", F.xxhash64(root, F.lit("print")).alias("bucket")
    )


def clusters(sketches: DataFrame) -> DataFrame:
    """``key`` and ``cluster`` of all that share a bucket with another, over one row per key.

    ``sketches`` has ``key``, ``buckets`` and ``print``.
    """
    members = sketches.select("key", F.explode("buckets").alias("bucket")).union(print_buckets(sketches))
    shared = members.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    edges = members.join(shared.select("bucket", "first"), "bucket").select("first", "key").distinct()
    return components(edges).select(F.col("node").alias("key"), F.col("component").alias("cluster"))


def cells(sized: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Each key with the cells ``x``, ``y`` it goes to: pairs of blocks of its cluster.

    ``sized`` has ``key``, ``cluster`` and ``size``.
    """
    many = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / block_shingles))
    blocks = sized.groupBy("cluster").agg(many.cast("int").alias("blocks"))
    own = F.expr("cast(pmod(xxhash64(key), blocks) as int)")
    return (
        sized.join(blocks, "cluster")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .filter("blocks = 1 OR own != other")  # two blocks compare each of them as well
        .select("key", "cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    )


def near_links(texts: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all similar texts, over ``cluster``, ``x``, ``y``, ``key`` and ``text``."""
    return (
        texts.select("cluster", "x", "y", "key", "text")
        .repartition("cluster", "x", "y")
        .sortWithinPartitions("cluster", "x", "y")
        .mapInPandas(_cell_links, "a bigint, b bigint")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the row with the smallest id (and of these the smallest key).

    Rows equal in both have equal words; one of them stays. A null id sorts first.
    Tables of keys are broadcast where they are measured as small, else joined by a
    shuffle.
    """
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, key_id = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`")
    sketched = checkpointed(here.select(key_id.alias("id"), sketch(text).alias("s")).select("id", "s.*"))
    firsts = checkpointed(
        sketched.groupBy("key")
        .agg(
            F.min("id").alias("id"), F.count_if(F.col("id").isNull()).alias("nulls"),
            F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.first("print").alias("print"),
        )
        .withColumn("id", F.expr("if(nulls > 0, null, id)"))
    )
    clustered = checkpointed(clusters(firsts.select("key", "buckets", "print")))
    sized = clustered.join(firsts.select("key", "size", "id"), "key")
    placed = cells(sized.select("key", "cluster", "size")).join(sized.select("key", F.col("id").alias("first")), "key")
    marked = here.select("row", key_id.alias("id"), key_of(text).alias("key"))
    wanted = broadcast_if_small(placed)
    texts = marked.select("id", "key", text.alias("text")).join(wanted, "key").filter(F.col("id").eqNullSafe(F.col("first")))
    linked = components(near_links(texts)).select(F.col("node").alias("key"), "component")
    # groups of one text stay as they are: only keys that are linked need a look
    grouped = checkpointed(linked.join(firsts.select("key", "id"), "key"))
    kept = grouped.groupBy("component").agg(F.min(F.struct("id", "key")).alias("best")).select(F.col("best.key").alias("kept_key"))
    gone = grouped.join(kept, F.col("key") == F.col("kept_key"), "left_anti").select("key")
    # keys with more than one row: only the row with the first id stays
    repeated = (
        sketched.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(firsts.select("key", "id"), "key")
        .select("key", F.col("id").alias("first"), F.lit(False).alias("gone"))
    )
    looked = broadcast_if_small(
        repeated.join(gone, "key", "left_anti").union(gone.select("key", F.lit(None).cast(firsts.schema["id"].dataType), F.lit(True)))
    )
    judged = marked.join(looked, "key", "left")
    alone = judged.filter("gone is null").select("row.*")
    one_of = (
        judged.filter((F.col("gone") == F.lit(False)) & F.col("id").eqNullSafe(F.col("first")))
        .groupBy("key")
        .agg(F.min_by("row", F.xxhash64(text)).alias("row"))
        .select("row.*")
    )
    return alone.union(one_of)
