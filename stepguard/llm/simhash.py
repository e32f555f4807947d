"""Near duplicates by SimHash, linked through BK-trees.

The fingerprint of a text is 64 bits wide: each three-word shingle is hashed, and a
bit is set if it is set in more than half of the hashes. Fingerprints that differ
in two bits or fewer link, and linked documents form a group.

Links are searched among the distinct fingerprints only, so copies cost nothing.
The bits are cut in three; two fingerprints that differ in two bits have at least
one third in common, so each one goes to three shards, named by a third and its
value. A shard that holds more than ``TREE_SIZE`` fingerprints is cut again in the
same way along its open bits, until ``OPEN_BITS`` or fewer are open, where no more
than ``2 ** OPEN_BITS`` different values exist: a shard is bounded for any input.

A shard builds a BK-tree: a node's children are keyed by their Hamming distance to
it, and a query follows only the edges within the radius around its own distance
to the node. Everything below the edge of key *e* lies at exactly *e* from the
node; once a query is linked to the node, what lies within the radius of the node
is in its group already and isn't walked again. The fingerprints of a shard travel
to the task that builds its tree by the shuffle and are its queries, too; nothing
is broadcast, as no bound on all trees is known beforehand.

Null and empty texts have the fingerprint zero and link like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.llm.common import lowered_words, text_slices
from stepguard.llm.components import components
from stepguard.session import checkpointed

WORDS = 3
SEED = 42
RADIUS = 2
TREE_SIZE = 2048
OPEN_BITS = 13
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 16


def simhash(text: str) -> int:
    words = lowered_words(text)
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[WORDS - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends, strict=False)]
    total = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), SHINGLES):
        part = np.array(hashes[first : first + SHINGLES], dtype=">u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * total > len(hashes))
    return int.from_bytes(majority.tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """The 64 bits of the SimHash as a signed bigint.

    Marked as not deterministic only to keep the optimizer from evaluating it once
    more in a filter; equal texts have equal values.
    """

    @F.pandas_udf("bigint")
    def hashed(batch: pd.Series) -> pd.Series:
        found = [simhash(text) for _, part in text_slices(batch) for text in part]
        return pd.Series(np.array(found, dtype=np.uint64).view(np.int64))

    return hashed.asNondeterministic()(text)


class BKTree:
    """Distinct 64-bit values; children of a node keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, node = len(self.values) - 1, 0
        while new:
            distance = (self.values[node] ^ value).bit_count()
            below = self.children[node].get(distance)
            if below is None:
                self.children[node][distance] = new
                return
            node = below

    def within(self, value: int, radius: int = RADIUS) -> Iterator[int]:
        """Values within the radius, but for those that a found one is next to itself."""
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            least = max(0, distance - radius)
            if distance <= radius:
                yield self.values[node]
                least = radius + 1
            below = self.children[node]
            for edge in range(least, distance + radius + 1):
                if edge in below:
                    stack.append(below[edge])


def _links(values: list[int]) -> Iterator[tuple[int, int]]:
    """A forest that joins whatever the values of one shard link."""
    tree, root = BKTree(), {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for value in values:
        root[value] = value
        for other in tree.within(value):
            a, b = find(value), find(other)
            if a != b:
                root[a] = b
                yield value, other
        tree.insert(value)


def _cut(mask: int) -> list[int]:
    """The mask with one third more of the open bits, for each third."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    third = -(-len(free) // (RADIUS + 1))
    parts = [free[i : i + third] for i in range(0, len(free), third)]
    return [mask | sum(1 << bit for bit in part) for part in parts]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(prints: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints within the radius.

    ``prints`` has one column ``print``, each value once.
    """
    masks = _cut(0)
    deal = F.array(*[F.lit(_signed(m)) for m in masks])
    members = prints.select("print", F.explode(deal).alias("mask"))
    found = None
    while True:
        members = members.withColumn("bits", F.col("print").bitwiseAND(F.col("mask")))
        sizes = members.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        members = checkpointed(members.join(sizes, ["mask", "bits"]))
        open_bits = 64 - min(m.bit_count() for m in masks)
        final = open_bits <= OPEN_BITS
        ready = members if final else members.filter(F.col("n") <= tree_size)
        links = (
            ready.select("mask", "bits", "print")
            .repartition("mask", "bits")
            .sortWithinPartitions("mask", "bits", "print")
            .mapInPandas(_shard_links, "a bigint, b bigint")
        )
        found = links if found is None else found.union(links)
        large = members.filter(F.col("n") > tree_size)
        if final or large.isEmpty():
            return found
        finer = {m: _cut(m) for m in masks}
        to = F.create_map(
            *[x for m, cut in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cut]))]
        )
        members = large.select("print", F.explode(to[F.col("mask")]).alias("mask"))
        masks = [c for cut in finer.values() for c in cut]


def _shard_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each shard; the rows of a shard follow one another."""
    key, values = None, []
    for batch in batches:
        pairs: list[tuple[int, int]] = []
        for mask, bits, value in zip(*[batch[c].tolist() for c in ("mask", "bits", "print")], strict=True):
            if (mask, bits) != key:
                pairs += _links(values)
                key, values = (mask, bits), []
            values.append(value & (2**64 - 1))
        yield _frame(pairs)
    yield _frame(list(_links(values)))


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``print``, ``component`` and ``root`` for every row.

    The component is the smallest id of the group, the root one of its fingerprints.
    Copies meet in one fingerprint and are linked by it. Rows with equal ids are rows
    like others, so two groups can have one smallest id, but never one root.
    """
    hashed = checkpointed(
        docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("print"))
    )
    firsts = checkpointed(hashed.groupBy("print").agg(F.min("id").alias("first")))
    linked = components(near_links(firsts.select("print")))
    rooted = firsts.join(linked.select(F.col("node").alias("print"), "component"), "print", "left").select(
        "print", "first", F.coalesce("component", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root").select("print", "component", "root")
    return hashed.join(named, "print").select("id", "print", "component", "root")


def group_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return groups(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the row with the smallest id (and of these the smallest fingerprint).

    Rows equal in both are copies or links of one another; one of them stays. The
    texts move once, to meet the ids that stay. A null id sorts first.
    """
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = here.select(
        "row",
        F.col(f"row.`{id_col}`").alias("id"),
        fingerprint(F.col(f"row.`{text_col}`")).alias("print"),
    )
    stays = (
        groups(docs, id_col, text_col)
        .groupBy("root")
        .agg(F.min(F.struct("id", "print")).alias("first"))
        .select(F.col("first.id").alias("stay_id"), F.col("first.print").alias("stay_print"))
    )
    same = F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("print") == F.col("stay_print"))
    return (
        marked.join(stays, same, "left_semi")
        .groupBy("id", "print")
        .agg(F.min_by("row", F.xxhash64(f"row.`{text_col}`")).alias("row"))
        .select("row.*")
    )
