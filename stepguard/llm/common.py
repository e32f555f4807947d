"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that one step of a Python operator holds at a time.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(sizes: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive ranges whose sizes add up to the limit at most, one row at least."""
    start, held = 0, 0
    for position, size in enumerate(sizes):
        if position > start and held + size > limit:
            yield slice(start, position)
            start, held = position, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_slices(batch: pd.Series, limit: int = SLICE_CHARS) -> Iterator[tuple[slice, list[str]]]:
    """The texts of a batch in bounded parts; null counts as empty."""
    texts = ["" if t is None or t != t else t for t in batch]
    for part in slices([len(t) for t in texts], limit):
        yield part, texts[part]


def lowered_words(text: str) -> list[bytes]:
    """The words of a text as UTF-8 with A to Z in lower case.

    Bytes methods touch ASCII only, and split at exactly the characters of SPACE.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer, elementwise; equal input gives equal output everywhere."""
    x = values.astype(np.uint64, copy=True) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A number in [0, 1) for each value."""
    return (mixed(values, seed) >> np.uint64(11)).astype(np.float64) / 2.0**53


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append columns; a column of the input with the same name gives way."""
    lower = {name.lower() for name in columns}
    kept = [F.col(f"`{name}`") for name in df.columns if name.lower() not in lower]
    return df.select(*kept, *[column.alias(name) for name, column in columns.items()])
