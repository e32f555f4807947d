"""Ordered work inside groups that stays bounded when one group is huge.

A plain window sends every row of a group to one task. That is the plan used here
for tables of ``segment_rows`` rows at most, which any one task can order; the row
count is read without the columns. A larger table is partitioned by ranges of
(group, order key), which Spark samples itself, into segments of about
``segment_rows`` rows, as many as that takes, and stored in the shared folder. Each
piece of a group in a segment becomes a window of its own:

* expressions that look back a fixed number of rows get the last rows of the
  group's earlier segments added in front of each segment;
* running sums get the sum of the group's earlier segments added.

Only groups at the edge of a segment can need either, two per segment at most; what
is broadcast is a row for each of these and each of their segments. The cost per row
doesn't depend on the number of segments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stepguard.session import checkpointed

SEGMENT_ROWS = 2_000_000

_ALL = "__all_rows"
_SEGMENT = "__segment"
_HALO = "__halo"


def _keyed(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group:
        return df, list(group)
    return df.withColumn(_ALL, F.lit(0)), [_ALL]


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join with a table of a row per cut or two, dropping its keys."""
    renamed = small.withColumnsRenamed({key: f"__r_{key}" for key in keys})
    same = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__r_{key}")) for key in keys]
    )
    joined = df.join(F.broadcast(renamed), same, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


def _segmented(
    df: DataFrame, group: list[str], order: list[str], segment_rows: int
) -> tuple[DataFrame, DataFrame] | None:
    """Rows with their segment, and the groups at segment edges; None for a small table.

    The rows are stored, as the ranges that Spark draws may differ between two reads.
    """
    total = df.count()
    if total <= segment_rows:
        return None
    names = list(dict.fromkeys([*group, *order]))
    ranged = df.repartitionByRange(-(-total // segment_rows), *names)
    rows = checkpointed(ranged.withColumn(_SEGMENT, F.spark_partition_id()))
    key = F.struct(*group)
    edges = rows.groupBy(_SEGMENT).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    at_edges = edges.select(F.explode(F.array("first", "last")).alias("edge")).select("edge.*").distinct()
    return rows, at_edges


def over_history(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    depth: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add window columns that look back at most ``depth`` rows within a group.

    ``build`` gets the window (partitioned and ordered, ascending) and returns
    the new columns. ``order`` must be unique inside a group. An empty
    ``group`` treats the whole table as one sequence.
    """
    order = list(order)
    keyed, keys = _keyed(df, group)
    cut = _segmented(keyed, keys, order, segment_rows)
    if cut is None:
        columns = build(Window.partitionBy(*keys).orderBy(*order))
        return keyed.withColumns(columns).drop(_ALL)

    rows, through = cut
    names = rows.columns
    latest = Window.partitionBy(*keys, _SEGMENT).orderBy(*[F.desc(name) for name in order])
    tails = (
        _attach(rows, through, keys, "inner")
        .withColumn("__from_end", F.row_number().over(latest))
        .filter(F.col("__from_end") <= depth)
    )
    ordered = Window.partitionBy(*keys).orderBy(*order)
    seen = tails.withColumn(
        "__seen",
        F.collect_list(F.struct(*names)).over(ordered.rowsBetween(-(depth - 1), 0)),
    ).filter(F.col("__from_end") == 1)
    halo = (
        seen.withColumn(
            "__seen", F.lag("__seen").over(Window.partitionBy(*keys).orderBy(_SEGMENT))
        )
        .select(F.col(_SEGMENT).alias("__target"), F.explode("__seen").alias("__row"))
        .select("__row.*", "__target")
        .withColumn(_SEGMENT, F.col("__target"))
        .drop("__target")
        .withColumn(_HALO, F.lit(True))
    )
    together = rows.withColumn(_HALO, F.lit(False)).unionByName(halo)
    columns = build(Window.partitionBy(*keys, _SEGMENT).orderBy(*order))
    return together.withColumns(columns).filter(~F.col(_HALO)).drop(_HALO, _SEGMENT, _ALL)


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    totals: dict[str, Column] | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add inclusive running sums in key order, and whole-group totals.

    ``order`` must be unique inside a group.
    """
    order = list(order)
    totals = totals or {}
    keyed, keys = _keyed(df, group)
    cut = _segmented(keyed, keys, order, segment_rows)

    def running(*partition: str) -> WindowSpec:
        return (
            Window.partitionBy(*partition)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

    if cut is None:
        columns = {name: F.sum(value).over(running(*keys)) for name, value in sums.items()}
        whole = Window.partitionBy(*keys)
        columns |= {name: F.sum(value).over(whole) for name, value in totals.items()}
        return keyed.withColumns(columns).drop(_ALL)

    rows, through = cut
    parts = (
        _attach(rows, through, keys, "inner")
        .groupBy(*keys, _SEGMENT)
        .agg(
            *[F.sum(value).alias(f"__s_{name}") for name, value in sums.items()],
            *[F.sum(value).alias(f"__t_{name}") for name, value in totals.items()],
        )
    )
    before = (
        Window.partitionBy(*keys).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = parts.select(
        *keys,
        _SEGMENT,
        *[F.sum(f"__s_{name}").over(before).alias(f"__s_{name}") for name in sums],
        *[
            F.sum(f"__t_{name}").over(Window.partitionBy(*keys)).alias(f"__t_{name}")
            for name in totals
        ],
    )
    joined = _attach(rows, parts, [*keys, _SEGMENT])
    local = running(*keys, _SEGMENT)
    whole = Window.partitionBy(*keys, _SEGMENT)
    columns = {
        name: F.sum(value).over(local) + F.coalesce(F.col(f"__s_{name}"), F.lit(0))
        for name, value in sums.items()
    }
    columns |= {
        name: F.coalesce(F.col(f"__t_{name}"), F.sum(value).over(whole))
        for name, value in totals.items()
    }
    return joined.withColumns(columns).drop(
        *[f"__s_{name}" for name in sums],
        *[f"__t_{name}" for name in totals],
        _SEGMENT,
        _ALL,
    )


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    levels: dict[str, float],
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Equal values are counted first, so the ordered pass sees each distinct
    value once, and no group is gathered in one task. The counts are stored,
    since the row count and the ordered pass both read them.
    """
    counted = checkpointed(
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ranked = running_totals(
        counted, group, [value], {"__upto": F.col("__n")}, {"__all": F.col("__n")}, segment_rows
    )

    def at_rank(rank: Column) -> Column:
        hit = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(hit, F.col(value)))

    out = []
    for name, level in levels.items():
        position = (F.col("__all") - 1) * F.lit(float(level))
        low = at_rank(F.floor(position))
        high = at_rank(F.ceil(position))
        part = F.max(position - F.floor(position))
        out.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*group).agg(*out)
