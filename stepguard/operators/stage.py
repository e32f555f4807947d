"""Keeping long expressions from being repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that many later expressions read.

    The optimizer substitutes plain projections into filters and projections
    above them, which multiplies long texts and parsers. It does not look
    through a generator, so the columns come out of a one-element array.
    """
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    entry = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(entry)))


def read_once(
    df: DataFrame, source: str, build: Callable[[Column], dict[str, Column]]
) -> DataFrame:
    """Like :func:`computed_once`, for many columns parsed out of one.

    ``build`` gets the source column. A parser with dozens of patterns in one
    generated method is too large for the JIT compiler; inside a lambda each
    pattern stays a small call of its own.
    """
    def entry(value: Column) -> Column:
        return F.struct(*[column.alias(name) for name, column in build(value).items()])

    return df.select("*", F.inline(F.transform(F.array(F.col(source)), entry)))
