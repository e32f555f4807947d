"""Quality rules whose thresholds adapt to language and source.

Counts of each text feed five shares. Their distribution is sketched per language
and source: a sketch is a count per quantised value (six leading bits, so a value
is off by 1/32 at most), has a few hundred entries whatever the number of
documents, and merges by adding counts. Quartiles come from the sketches, and a
document is kept if every share lies within ``REACH`` times the quartile distance
(or the share's tolerance, if larger) around the quartiles. A language and source
with fewer than ``LEAST_DOCUMENTS`` documents takes the merged sketches of the
language, and if these are too few as well those of all documents.

Documents that fail the base rule don't enter the sketches. Null text has no words;
null languages and sources form groups like others. Repeated rows count each.

DataFrame operations only. The first pass leaves one small table of thresholds; the
second joins it, broadcast if its measured size allows, else by a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.llm.common import SPACE, replaced
from stepguard.operators.stage import computed_once
from stepguard.session import broadcast_if_small, checkpointed

# The base rule.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

REACH = 6
LEAST_DOCUMENTS = 30
#: Shares (per ten thousand; word length in hundredths) and the least quartile distance of each.
TOLERANCES = {"symbols": 300, "neighbours": 300, "lines": 600, "length": 40}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*COUNTS, "n_lines", "n_neighbours"]


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the document), and the counts in ``MEASURES`` beside it."""
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = computed_once(
        rows,
        {
            "words": F.filter(F.split(text, SPACE, -1), lambda w: w != ""),
            "lines": F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0),
        },
    )
    rows = computed_once(
        rows.select(
            "row",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        ),
        {},
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size("hashes") - WINDOW),
        lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]),
    )
    rows = computed_once(
        rows.withColumn(
            "n_neighbours",
            F.size(F.filter("hashes", lambda h, i: (i > 0) & (h == F.get("hashes", i - 1)))).cast("long"),
        ),
        {"windows": F.when(F.size("hashes") >= WINDOW, window).otherwise(F.array().cast("array<bigint>"))},
    ).drop("hashes")
    # only texts with an equal pair of windows are ordered
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = computed_once(rows, {"placed": placed}).drop("windows")
    twice = F.filter(
        "placed",
        lambda s, i: ((i > 0) & (s["h"] == F.get("placed", i - 1)["h"]))
        | F.coalesce(s["h"] == F.get("placed", i + 1)["h"], F.lit(False)),
    )
    rows = computed_once(
        rows, {"starts": F.array_sort(F.transform(twice, lambda s: s["i"]))}
    ).drop("placed")
    covered = F.aggregate(
        F.transform(
            "starts",
            lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return rows.select("row", *[c for c in MEASURES if c != "n_repeat_words"], covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def shares() -> dict[str, Column]:
    def share(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole)).cast("long")).otherwise(0)

    return {
        "symbols": share("n_symbols", "n_words", 10_000),
        "neighbours": share("n_neighbours", "n_words", 10_000),
        "lines": share("n_dup_lines", "n_lines", 10_000),
        "length": share("word_chars", "n_words", 100),
    }


def quantised(value: Column) -> Column:
    """The six leading bits of a whole number, the rest zero."""
    scale = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return value - value % scale


def sketches(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``rule``, ``value`` and the ``n`` documents with it, per key."""
    entries = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("share")) for k, v in shares().items()])
    return (
        counts.filter(~base_failed())
        .select(*keys, F.inline(entries))
        .groupBy(*keys, "rule", quantised(F.col("share")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key that has enough documents: ``low`` and ``high`` of each rule."""
    merged = sketch.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "rule")
    placed = merged.select(
        *keys, "rule", "value",
        F.sum("n").over(whole.orderBy("value")).alias("upto"),
        F.sum("n").over(whole).alias("total"),
    )
    quartiles = placed.groupBy(*keys, "rule").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("value"))).alias("q3"),
    )
    tolerance = F.create_map(*[F.lit(x) for kv in TOLERANCES.items() for x in kv])[F.col("rule")]
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), tolerance)
    bounded = quartiles.filter(F.col("total") >= LEAST_DOCUMENTS).select(
        *keys, "rule", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")
    )
    per_rule = [
        F.max(F.when(F.col("rule") == rule, F.struct("low", "high"))).alias(rule) for rule in TOLERANCES
    ]
    return bounded.groupBy(*keys).agg(*per_rule)


def thresholds(counts: DataFrame) -> DataFrame:
    """``lang``, ``source`` and the (low, high) of each rule; counts have both columns."""
    sketch = checkpointed(sketches(counts, ["lang", "source"]))
    groups = sketch.select("lang", "source").distinct()
    own = fences(sketch, ["lang", "source"])
    language = fences(sketch, ["lang"])
    whole = fences(sketch.withColumn("all", F.lit(0)), ["all"]).first()  # one row of a few numbers
    everything = F.lit(None)
    if whole is not None:
        limits = {r: [F.lit(v).cast("long").alias(k) for k, v in whole[r].asDict().items()] for r in TOLERANCES}
        everything = F.struct(*[F.struct(*pair).alias(rule) for rule, pair in limits.items()])
    named = [
        f.select(*keys, F.struct(*TOLERANCES).alias(name))
        for name, f, keys in (("own", own, ["lang", "source"]), ("language", language, ["lang"]))
    ]
    joined = (
        groups.alias("g")
        .join(named[0].alias("o"), F.expr("g.lang <=> o.lang AND g.source <=> o.source"), "left")
        .join(named[1].alias("l"), F.expr("g.lang <=> l.lang"), "left")
    )
    return joined.select("g.lang", "g.source", F.coalesce("o.own", "l.language", everything).alias("fence"))


def judged(counts: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept``; without any threshold only the base rule decides."""
    t = broadcast_if_small(table.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "fence"))
    joined = counts.join(
        t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left"
    )
    inside = [
        F.coalesce(share.between(F.col(f"fence.{rule}.low"), F.col(f"fence.{rule}.high")), F.lit(True))
        for rule, share in shares().items()
    ]
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, inside)
    ).drop("t_lang", "t_source", "fence")


def _keyed(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return counted(docs, text_col).select(
        "row",
        *MEASURES,
        F.col(f"row.`{lang_col}`").cast("string").alias("lang"),
        F.col(f"row.`{source_col}`").cast("string").alias("source"),
    )


def verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Counts and verdict of every document; the counts are stored, texts are read once."""
    counts = checkpointed(
        _keyed(docs, text_col, lang_col, source_col).select(
            F.col(f"row.`{id_col}`").alias(id_col), *MEASURES, "lang", "source"
        )
    )
    return judged(counts, thresholds(counts)).select(id_col, *COUNTS, "base_failed", "kept", "n_lines", "n_neighbours")


def keep_good(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The documents the rules keep, with their columns; texts are read twice and not moved."""
    counts = _keyed(docs, text_col, lang_col, source_col)
    stored = checkpointed(thresholds(counts))
    return judged(counts, stored).filter("kept").select("row.*")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
win AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
c AS MATERIALIZED (
  SELECT d.rid, d.doc_id, d.lang, d.source, len(w.words) AS n_words,
         length(array_to_string(w.words, '')) AS word_chars,
         len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols,
         len(w.lines) AS n_lines, len(w.lines) - len(list_distinct(w.lines)) AS n_dup_lines,
         coalesce(covered.n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(range(2, len(w.words) + 1), lambda i: w.words[i] = w.words[i - 1])) AS n_neighbours
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid)),
s AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 10000 * n_symbols // n_words ELSE 0 END AS symbols,
         CASE WHEN n_words > 0 THEN 10000 * n_neighbours // n_words ELSE 0 END AS neighbours,
         CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS lines,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS length
  FROM c),
entries AS (
  SELECT lang, source, 'symbols' AS rule, symbols AS share FROM s WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'neighbours', neighbours FROM s WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'lines', lines FROM s WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'length', length FROM s WHERE NOT base_failed),
levels AS MATERIALIZED (
  SELECT *, (share >> greatest(0, length(bin(share)) - 6)) << greatest(0, length(bin(share)) - 6) AS value
  FROM (SELECT 2 AS level, * FROM entries
        UNION ALL SELECT 1, lang, NULL, rule, share FROM entries
        UNION ALL SELECT 0, NULL, NULL, rule, share FROM entries)),
placed AS (
  SELECT level, lang, source, rule, value,
         count(*) OVER (PARTITION BY level, lang, source, rule ORDER BY value) AS upto,
         count(*) OVER (PARTITION BY level, lang, source, rule) AS total
  FROM levels),
quartiles AS (
  SELECT level, lang, source, rule, max(total) AS total,
         min(value) FILTER (4 * upto >= total) AS q1, min(value) FILTER (4 * upto >= 3 * total) AS q3
  FROM placed GROUP BY level, lang, source, rule),
fence AS MATERIALIZED (
  SELECT level, lang, source, rule,
         q1 - 6 * greatest(q3 - q1, tolerance) AS low, q3 + 6 * greatest(q3 - q1, tolerance) AS high
  FROM quartiles JOIN (VALUES ('symbols', 300), ('neighbours', 300), ('lines', 600), ('length', 40))
       t(rule, tolerance) USING (rule)
  WHERE total >= 30),
judged AS (
  SELECT s.rid, bool_and(coalesce(v.share BETWEEN coalesce(o.low, l.low, e.low)
                                             AND coalesce(o.high, l.high, e.high), true)) AS inside
  FROM s,
  LATERAL (VALUES ('symbols', s.symbols), ('neighbours', s.neighbours), ('lines', s.lines),
                  ('length', s.length)) v(rule, share)
  LEFT JOIN fence o ON o.level = 2 AND o.rule = v.rule AND o.lang IS NOT DISTINCT FROM s.lang
                   AND o.source IS NOT DISTINCT FROM s.source
  LEFT JOIN fence l ON l.level = 1 AND l.rule = v.rule AND l.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN fence e ON e.level = 0 AND e.rule = v.rule
  GROUP BY s.rid)
"""
ORACLE = SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND inside AS kept, n_lines, n_neighbours
FROM s JOIN judged USING (rid)
"""
