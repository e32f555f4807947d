"""Document fingerprints by winnowing.

Every run of ``gram`` code points is hashed. Of each window of ``window``
neighbouring hashes the smallest is chosen, the rightmost one if several are
equal, and kept with its position. Two texts that share ``gram + window - 1``
code points in a row therefore share a fingerprint, and nothing shorter than
``gram`` can make them share one (but for a 32-bit hash that collides).

A text with fewer grams than a window has one window; a text shorter than
``gram`` is one gram; an empty (or null) text has no fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.llm.common import mixed, text_slices

GRAM = 12
WINDOW = 16
BASE = np.uint64(0x100000001B3)
NONE = np.uint64(2**64 - 1)
#: Texts are fingerprinted together in parts of so many characters.
PART_CHARS = 100_000


@dataclass
class Fingerprints:
    """Fingerprints of several texts: text number, position and hash of each one."""

    text: np.ndarray
    position: np.ndarray
    hash: np.ndarray
    texts: int

    def strings(self) -> list[str]:
        """Eight hex digits of the position and eight of the hash, for each in turn."""
        pairs = np.empty((len(self.text), 2), dtype=">u4")
        pairs[:, 0], pairs[:, 1] = self.position, self.hash
        digits = pairs.tobytes().hex()
        ends = np.cumsum(np.bincount(self.text, minlength=self.texts)) * 16
        return [digits[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def sets(self) -> np.ndarray:
        """Distinct (text, hash) pairs in one sorted array."""
        return np.unique(self.text.astype(np.uint64) << np.uint64(32) | self.hash)

    def rows(self, wanted: np.ndarray) -> Fingerprints:
        """The texts at the given places, renumbered."""
        starts = np.searchsorted(self.text, wanted)
        counts = np.searchsorted(self.text, wanted, side="right") - starts
        picks = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        picks += np.arange(len(picks))
        owner = np.repeat(np.arange(len(wanted)), counts)
        return Fingerprints(owner, self.position[picks], self.hash[picks], len(wanted))


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of the ``gram`` codes from each place, by doubling the span."""
    single = codes.astype(np.uint64) + np.uint64(1)
    held, span = single, 1
    for digit in bin(gram)[3:]:  # the bits of the length below the first one
        shifted = np.zeros_like(held)
        shifted[: len(held) - span] = held[span:]
        held = held * np.uint64(pow(int(BASE), span, 2**64)) + shifted
        span *= 2
        if digit == "1":
            shifted = np.zeros_like(held)
            shifted[: len(held) - span] = single[span:]
            held = held * BASE + shifted
            span += 1
    return held


def _window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of the ``window`` keys from each place, by doubling the span."""
    held, span = keys, 1
    while span < window:
        step = min(span, window - span)
        shifted = np.full_like(held, NONE)
        shifted[: len(held) - step] = held[step:]
        held = np.minimum(held, shifted)
        span += step
    return held


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> Fingerprints:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    gap = gram + window
    starts = np.concatenate(([0], np.cumsum(lengths + gap)))
    filler = "\0" * gap
    codes = np.frombuffer(
        (filler.join(texts) + filler).encode("utf-32-le", "surrogatepass"), dtype=np.uint32
    )
    hashes = (mixed(_gram_hashes(codes, gram)) >> np.uint64(32)).astype(np.uint64)
    grams = np.maximum(lengths - gram + 1, 0)
    for place in np.flatnonzero((lengths > 0) & (grams == 0)):  # shorter than one gram
        data = texts[place].encode("utf-8", "surrogatepass")
        whole = int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "big")
        hashes[starts[place]] = whole
        grams[place] = 1
    # a mask of the places at which a gram or a window begins, from its ends
    def mask(counts: np.ndarray) -> np.ndarray:
        edges = np.zeros(len(codes) + 1, dtype=np.int32)
        some = counts > 0
        edges[starts[:-1][some]] += 1
        edges[(starts[:-1] + counts)[some]] -= 1
        return np.cumsum(edges[:-1]) > 0

    places = np.arange(len(codes), dtype=np.uint64)
    # the smallest key has the smallest hash, and of these the rightmost place
    keys = np.where(mask(grams), hashes << np.uint64(32) | np.uint64(2**32 - 1) - places, NONE)
    windows = np.where(grams > 0, np.maximum(grams - window + 1, 1), 0)
    chosen = _window_minima(keys, window)[mask(windows)]
    if len(chosen):
        chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    place = (np.uint64(2**32 - 1) - (chosen & np.uint64(2**32 - 1))).astype(np.int64)
    text = np.searchsorted(starts, place, side="right") - 1
    return Fingerprints(text, place - starts[text], chosen >> np.uint64(32), len(texts))


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """Shared among all distinct hashes of two texts; two texts without any are alike."""
    left, right = a.sets(), b.sets()
    shared = np.intersect1d(left, right, assume_unique=True)
    shift = np.uint64(32)
    count = [np.bincount((x >> shift).astype(np.int64), minlength=a.texts) for x in (left, right, shared)]
    union = count[0] + count[1] - count[2]
    return np.where(union > 0, count[2] / np.maximum(union, 1), 1.0)


def fingerprint_column(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprint of each text as an array of structs (position, hash)."""

    @F.pandas_udf("array<struct<position:int,hash:bigint>>")
    def chosen(batch: pd.Series) -> pd.Series:
        out = []
        for _, texts in text_slices(batch, PART_CHARS):
            found = fingerprints(texts, gram, window)
            pairs = list(zip(found.position.tolist(), found.hash.tolist(), strict=True))
            ends = np.cumsum(np.bincount(found.text, minlength=found.texts))
            out += [pairs[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        return pd.Series(out)

    return chosen(text)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ``id``, ``text``, ``last``, dealt by ranges of the id and sorted.

    The ranges are cut at quantiles of the ids, as many as the session has shuffle
    partitions. The first document of a range comes once more at the end of the
    range before it (of the last one, for the first range) with ``last`` set, so
    each document's successor follows it. The texts move once. Only bounds and the
    ranges' first ids, one of each per partition, pass through the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = ids.agg(F.percentile_approx("id", shares, 20 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else None
    place = F.size(F.filter(limits, lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    firsts = (
        ids.withColumn("place", place)
        .groupBy("place")
        .agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("empty"))
        .orderBy("place")
        .collect()
    )
    if not firsts:
        return docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("last")
        )
    before, first = [0] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for row, previous in zip(firsts, [firsts[-1], *firsts[:-1]], strict=True):
        before[row.place] = previous.place
        first[row.place] = None if row.empty else row.first
    here = F.col("place") + 1
    first_id = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), here)
    before_it = F.element_at(F.array(*[F.lit(x) for x in before]), here)
    own = F.struct(F.col("place").alias("part"), F.lit(False).alias("last"))
    again = F.struct(before_it.alias("part"), F.lit(True).alias("last"))
    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .withColumn("place", place)
        .withColumn(
            "to", F.explode(F.when(F.col("id").eqNullSafe(first_id), F.array(own, again)).otherwise(F.array(own)))
        )
        .select("id", "text", "to.*")
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("last", "id", "text")
        .select("id", "text", "last")
    )


def edited_texts(texts: list[str], following: list[str]) -> list[str]:
    return [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]


def _compared(ids: list, texts: list[str], following: str) -> pd.DataFrame:
    """The query's columns for texts in order, followed by one more."""
    edited = edited_texts(texts, [*texts[1:], following])
    own = fingerprints([*texts, following])
    changed = fingerprints(edited)
    n = len(texts)
    here = own.rows(np.arange(n))
    def strings(values: list[str]) -> pd.Series:
        return pd.Series(values, dtype=object)

    digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, dtype="Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": strings(digests),
            "fingerprint": strings(own.strings()[:n]),
            "edited_fingerprint": strings(changed.strings()),
            "near_edited": likeness(here, changed),
            "near_next": likeness(here, own.rows(np.arange(1, n + 1))),
        }
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """The columns of the registered query.

    Repeated ids are ordered by their texts; of those that a range's end needs, the
    first is taken. An empty table gives no rows; a single document follows itself.
    """

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list[str] = []
        held, ended = 0, False
        for batch in batches:
            values = batch["text"].tolist()
            keys = [None if pd.isna(k) else int(k) for k in batch["id"]]
            for key, text, last in zip(keys, values, batch["last"], strict=True):
                text = "" if text is None else text
                if ended:
                    continue
                if texts and (last or held + len(text) > PART_CHARS):
                    yield _compared(ids, texts, text)
                    ids, texts, held = [], [], 0
                ended = bool(last)
                ids.append(key)
                texts.append(text)
                held += len(text)

    return in_order(docs).mapInPandas(
        compared,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
