"""Mixing sources to target weights by pivotal rounding.

Each source has a target number of words, so each of its documents should be taken
``target / size of the source`` times: a whole number of times, and once more with
the probability that is left. Pivotal rounding makes that choice for all documents
together: two documents with open probabilities meet, and words are moved from one
to the other, at random in direction but fair on average, until one of the two is
decided; the other one, which keeps the rest, meets the next. As the words that
move leave the one and reach the other, the sum of words stays what it was, and the
source ends within one document of its target.

The meetings form a tree. Documents of a source are dealt by a hash to chunks of
about ``CHUNK``; a chunk is folded from the largest document to the smallest and
leaves one open document; the open ones of all chunks are dealt to chunks again,
until one is left in each source, which its own probability decides. A source with
a third of all documents is just a source with more chunks. If that last document
is a long one, the words it leaves over or short are moved on: documents of at most
half that size are opened again, each by an equal part of these words, and rounded
in the same way; after a few turns the rest is a short document's. Draws are hashes, so
reruns agree. Every decision is returned by the level at which it falls; rows are
never joined back to them, so repeated ids do no harm.

Sources are ordered by code point (null last) and weigh 5, 2, 1 in turn. A source
takes ``MOST`` times its size at most; what is above is shared out by weight among
the others. Documents without words take part with nothing. An empty table gives
no rows. The table of sources is ordered in one task; it has one row per source.

DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.llm.common import word_count
from stepguard.session import broadcast_if_small, checkpointed

# The weights in turn, and how many times a source may be taken.
WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK = 128
#: How often what a source's last document leaves over is moved to smaller ones.
TURNS = 4
SEED = 5


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to rows of ``source`` and ``source_size``."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1)
    weighted = sources.select("*", weight.alias("weight"), (MOST * F.col("source_size")).alias("most"))
    everything = Window.partitionBy(F.lit(0))
    by_limit = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    # if this source and all with a higher limit aren't stopped, a unit of weight gets so much
    unit = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    placed = weighted.select("*", unit.alias("unit"), F.row_number().over(by_limit).alias("place"))
    fits = F.col("most") >= F.col("unit") * F.col("weight")
    first = F.min(F.when(fits, F.struct("place", "unit"))).over(everything)["unit"]
    target = F.least(F.col("most").cast("double"), first * F.col("weight"))
    return placed.select(*sources.columns, target.alias("target"))


def _draw(level: int, *parts: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(level), *parts), 11)
    return bits.cast("double") / F.lit(2.0**53)


OPEN = "id bigint, size bigint, p double, draw double"


def _meet(state: Column, x: Column) -> Column:
    """One meeting: ``state`` has the open document and those decided so far."""
    u = state["open"]
    u_words, x_words = u["p"] * u["size"], x["p"] * x["size"]
    u_room, x_room = (1 - u["p"]) * u["size"], (1 - x["p"]) * x["size"]
    to_u, to_x = F.least(u_room, x_words), F.least(u_words, x_room)

    def still(d: Column, p: Column) -> Column:
        return F.struct(d["id"].alias("id"), d["size"].alias("size"), p.alias("p"), d["draw"].alias("draw"))

    def decided(d: Column, once_more: int) -> Column:
        return F.struct(d["id"].alias("id"), d["size"].alias("size"), F.lit(once_more).alias("extra"))

    def outcome(stays: Column, gone: Column) -> Column:
        return F.struct(stays.alias("open"), F.concat(state["done"], F.array(gone)).alias("done"))

    up = x["draw"] * (to_u + to_x) < to_x
    met = (
        F.when(up & (u_room <= x_words), outcome(still(x, x["p"] - to_u / x["size"]), decided(u, 1)))
        .when(up, outcome(still(u, u["p"] + to_u / u["size"]), decided(x, 0)))
        .when(u_words <= x_room, outcome(still(x, x["p"] + to_x / x["size"]), decided(u, 0)))
        .otherwise(outcome(still(u, u["p"] - to_x / u["size"]), decided(x, 1)))
    )
    return F.when(u.isNull(), F.struct(x.alias("open"), state["done"].alias("done"))).otherwise(met)


def rounded(rows: DataFrame, most_rows: int) -> DataFrame:
    """``source``, ``id``, ``size``, ``extra`` (0 or 1) for rows of source, id, size and p.

    ``rows`` also has ``source_rows``; ``most_rows`` is the largest of these.
    """
    columns = ["source", "source_rows", "id", "size", "p"]
    current, level, done, largest = rows.select(*columns), 0, [], most_rows
    while True:
        chunks = F.ceil(F.col("source_rows") / float(CHUNK) ** (level + 1)).cast("long")
        dealt = current.withColumn(
            "chunk", F.pmod(F.xxhash64(F.lit(SEED + 1), F.lit(level), "id", "size"), chunks)
        ).withColumn("draw", _draw(level, F.col("id"), F.col("size")))
        member = F.struct((-F.col("size")).alias("order"), "id", "size", "p", "draw")
        folded = dealt.groupBy("source", "source_rows", "chunk").agg(
            F.array_sort(F.collect_list(member)).alias("members")
        )
        start = F.struct(
            F.lit(None).cast(f"struct<{OPEN.replace(' ', ':').replace(',:', ',')}>").alias("open"),
            F.array().cast("array<struct<id:bigint,size:bigint,extra:int>>").alias("done"),
        )
        members = F.transform("members", lambda m: F.struct(m["id"].alias("id"), m["size"].alias("size"), m["p"].alias("p"), m["draw"].alias("draw")))
        stored = checkpointed(
            folded.select("source", "source_rows", F.aggregate(members, start, _meet).alias("state"))
        )
        done.append(stored.select("source", F.inline("state.done")))
        current = stored.select("source", "source_rows", "state.open.id", "state.open.size", "state.open.p")
        level += 1
        largest = -(-largest // CHUNK)
        if largest <= 1:
            break
    final = (_draw(level, F.col("id"), F.col("size")) < F.col("p")).cast("int")
    done.append(current.select("source", "id", "size", final.alias("extra")))
    return reduce(DataFrame.union, done)


def reopened(decided: DataFrame, plan: DataFrame) -> DataFrame:
    """Decided rows with ``p`` where they are open once more, and ``source_rows`` of these.

    The last open document of a source leaves words over or short. They are moved to
    the documents of at most half that size which can give or take them.
    """
    named = decided.join(plan, F.col("source").eqNullSafe(F.col("of")))
    taken = named.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("size") * (F.col("whole") + F.col("extra")))).alias("gap"),
        F.max("whole").alias("whole"),
    )
    gaps = broadcast_if_small(taken.select(F.col("source").alias("of"), "gap", "whole"))
    marked = decided.join(gaps, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "id", "size", "extra", "gap",
        (
            (F.col("size") > 0) & (2 * F.col("size") <= F.abs("gap")) & (F.col("whole") < MOST)
            & (F.col("extra") == (F.col("gap") < 0).cast("int"))
        ).alias("again"),
    )
    sums = marked.filter("again").groupBy("source").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("source_rows")
    )
    sums = broadcast_if_small(sums.withColumnRenamed("source", "of"))
    part = F.least(F.lit(1.0), F.abs("gap") / F.col("words"))
    return marked.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_rows", "id", "size", "extra",
        F.when(F.col("again"), F.when(F.col("gap") > 0, part).otherwise(1 - part)).alias("p"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` for every document."""
    sized = checkpointed(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
        )
    )
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("source_rows")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = broadcast_if_small(
        targets(sources)
        .withColumn("rate", rate)
        .select(
            F.col("source").alias("of"), "source_size", "source_rows", "target",
            F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
        )
    )
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "source_rows", "id", "size", F.lit(0).alias("extra"),
        F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("p")).alias("p"),
    )
    for turn in range(TURNS):
        most = rows.agg(F.max(F.when(F.col("p").isNotNull(), F.col("source_rows")))).first()[0]
        if not most:
            break
        settled = rows.filter(F.col("p").isNull()).select("source", "id", "size", "extra")
        rows = checkpointed(rounded(rows.filter(F.col("p").isNotNull()), most).union(settled))
        if turn + 1 < TURNS:
            rows = reopened(rows, plan)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "size", "source", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")
    )


def mixture_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return mixture(docs).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "source",
        "copies",
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each document as many times as the mixture takes it.

    Rows with one id are numbered by size and text; the nth row goes with the nth
    decision. The texts move once.
    """
    decided = mixture(docs, id_col, text_col, source_col)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("source", "size", "copies"))
    decided = decided.select("id", "source", "size", "copies").withColumn("nth", nth)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    ).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("source", "size", "hash")))
    taken = decided.select(F.col("id").alias("the_id"), F.col("nth").alias("the_nth"), "copies").filter("copies > 0")
    return (
        rows.join(taken, F.col("id").eqNullSafe(F.col("the_id")) & (F.col("nth") == F.col("the_nth")))
        .select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select("row.*")
    )
