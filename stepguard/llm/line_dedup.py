"""Boilerplate lines of a site, by the share of its pages that contain them.

Pages are grouped by host. A line is boilerplate of a host if more than
``MAX_RATIO`` of the host's pages contain it, and ``LEAST_PAGES`` of them at least;
it is dropped from every page of the host. Equal pages of a host count once, so a
page that was fetched many times doesn't turn its own lines into boilerplate. A
line counts once per page; lines without a visible character are never dropped.

A host has no more boilerplate lines than its mean number of lines per page over
``MAX_RATIO``. Lines and pages are compared by 64-bit hashes. Null hosts form one
host, null texts stay null and have no lines, and a page whose lines are all
dropped stays with an empty text.

DataFrame operations only. Texts aren't moved: counts are summed before and after
one exchange of hashes, so a hot host or line makes no hot task, and the lines to
drop meet the pages in a join that is broadcast if its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.session import broadcast_if_small

MAX_RATIO = 0.02
LEAST_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _visible(line: Column) -> Column:
    return F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0


def boilerplate(
    docs: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, least: int = LEAST_PAGES
) -> DataFrame:
    """``host`` and the hashes ``drop`` of the lines to drop, for hosts that have any."""
    text = F.col(f"`{text_col}`")
    hashed = F.array_distinct(F.transform(F.filter(_lines(text), _visible), lambda x: F.xxhash64(x)))
    pages = docs.filter(text.isNotNull()).select(
        F.col(f"`{host_col}`").cast("string").alias("host"), F.xxhash64(text).alias("page"), hashed.alias("lines")
    )
    # one row for the page itself (no line) and one for each of its lines, each once
    entries = pages.select(
        "host", "page", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "lines")).alias("line")
    ).distinct()
    counts = entries.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = counts.filter(F.col("line").isNull()).select(F.col("host").alias("of"), F.col("pages").alias("total"))
    return (
        counts.filter(F.col("line").isNotNull() & (F.col("pages") >= least))
        .join(totals, F.col("host").eqNullSafe(F.col("of")))
        .filter(F.col("pages") > max_ratio * F.col("total"))
        .groupBy("host")
        .agg(F.collect_set("line").alias("drop"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    least: int = LEAST_PAGES,
) -> DataFrame:
    """The documents with shortened texts, and ``n_lines`` and ``n_dropped`` beside them."""
    drops = boilerplate(docs, host_col, text_col, max_ratio, least).withColumnRenamed("host", "of")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    host = F.col(f"row.`{host_col}`").cast("string")
    text = F.col(f"row.`{text_col}`")
    joined = rows.join(broadcast_if_small(drops), host.eqNullSafe(F.col("of")), "left")
    stays = F.filter(
        _lines(text), lambda x: ~F.coalesce(_visible(x) & F.array_contains("drop", F.xxhash64(x)), F.lit(False))
    )
    marked = joined.select(
        "row",
        F.when(F.col("of").isNull() & F.col("drop").isNull(), _lines(text)).otherwise(stays).alias("stays"),
        F.coalesce(F.size(_lines(text)), F.lit(0)).alias("n_lines"),
    )
    before, after = [F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) for n in (F.col("n_lines"), F.size("stays"))]
    lower = {text_col.lower(), "n_lines", "n_dropped"}
    return marked.select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in lower],
        F.array_join("stays", "\n").alias(text_col),
        before.cast("long").alias("n_lines"),
        (before - after).cast("long").alias("n_dropped"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
lines AS (
  SELECT rid, doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place
  FROM d),
counts AS (
  SELECT source, line, count(DISTINCT text) AS pages FROM lines
  WHERE regexp_matches(line, '[^ \t\x0B\f\r]') GROUP BY source, line),
totals AS (SELECT source, count(DISTINCT text) AS total FROM d WHERE text IS NOT NULL GROUP BY source),
dropped AS (
  SELECT counts.source, line FROM counts JOIN totals ON counts.source IS NOT DISTINCT FROM totals.source
  WHERE pages >= 5 AND pages > 0.02 * total),
marked AS (
  SELECT lines.*, dropped.line IS NOT NULL AS gone
  FROM lines LEFT JOIN dropped ON lines.source IS NOT DISTINCT FROM dropped.source AND lines.line = dropped.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM marked GROUP BY rid, doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM d WHERE text IS NULL
"""
