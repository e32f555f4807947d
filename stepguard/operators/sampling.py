"""Seeded sampling, deduplication and replication.

Selections compare a hash key with a cut key instead of ranking a whole
stratum: a histogram of the leading hash bits finds the bin that holds the
wanted rank, a second one of the next bits the part of the bin, and only that part
(about one row in four billion) is ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepguard.functions.hashing import leading_bits, seeded_key
from stepguard.session import broadcast_if_small

BIN_DIGITS = 4
BELOW_ALL = ""
ABOVE_ALL = "g"  # sorts behind every hex digit


def cut_keys(df: DataFrame, strata: Sequence[str], key: str, wanted: DataFrame) -> DataFrame:
    """For each stratum the keys below or at which exactly the wanted numbers of rows lie.

    ``wanted`` has the strata and one column per cut; the result has the same
    columns with the cut keys. Keys must be unique hex text.
    """
    strata = list(strata)
    cuts = [c for c in wanted.columns if c not in strata]
    rows = df.select(
        *strata, F.col(key).alias("__key"), leading_bits(F.col(key), BIN_DIGITS).alias("__bin")
    )
    bins = rows.groupBy(*strata, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*strata).orderBy("__bin"))
    summary = []
    for c in cuts:
        inside = F.col("__upto") >= F.col(c)
        summary.append(F.min(F.when(inside, F.col("__bin"))).alias(f"__bin_{c}"))
        before = F.max(F.when(~inside, F.col("__upto")))
        summary.append(F.coalesce(before, F.lit(0)).alias(f"__before_{c}"))
    reached = broadcast_if_small(
        _null_safe_join(bins.withColumn("__upto", upto), wanted, strata)
        .groupBy(*strata, *cuts)
        .agg(*summary)
    )
    edges = _edge_keys(rows, reached, strata, cuts)

    def cut(c: str) -> Column:
        return (
            F.when(F.col(c) <= 0, F.lit(BELOW_ALL))
            .when(F.col(f"__bin_{c}").isNull(), F.lit(ABOVE_ALL))
            .otherwise(F.col(f"__edge_{c}"))
            .alias(c)
        )

    return _null_safe_join(reached, edges, strata, "left").select(*strata, *[cut(c) for c in cuts])


def _edge_keys(rows: DataFrame, reached: DataFrame, strata: list[str], cuts: list[str]) -> DataFrame:
    """The key at each cut, as ``__edge_<name>``, from the rows of its bin.

    The bin is split once more by the next digits, and only the part with the cut
    is ordered.
    """
    one_each = F.array(
        *[
            F.struct(
                F.lit(c).alias("__cut"),
                F.col(f"__bin_{c}").alias("__at"),
                (F.col(c) - F.col(f"__before_{c}")).alias("__rest"),
            )
            for c in cuts
        ]
    )
    wanted = reached.select(*strata, F.inline(one_each)).filter("__at IS NOT NULL AND __rest > 0")
    next_digits = F.substring("__key", BIN_DIGITS + 1, BIN_DIGITS)
    near = (
        _null_safe_join(rows, wanted, strata)
        .filter(F.col("__bin") == F.col("__at"))
        .withColumn("__part", leading_bits(next_digits, BIN_DIGITS))
    )
    keys = [*strata, "__cut"]
    parts = near.groupBy(*keys, "__rest", "__part").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part"))
    inside = F.when(F.col("__upto") >= F.col("__rest"), F.struct("__part", (F.col("__upto") - F.col("__n")).alias("b")))
    hit = parts.withColumn("__upto", upto).groupBy(*keys).agg(F.min(inside).alias("__hit"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__key"))
    return (
        _null_safe_join(near, hit, keys)
        .filter(F.col("__part") == F.col("__hit.__part"))
        .withColumn("__place", place)
        .filter(F.col("__hit.b") + F.col("__place") == F.col("__rest"))
        .groupBy(*strata)
        .agg(*[F.max(F.when(F.col("__cut") == c, F.col("__key"))).alias(f"__edge_{c}") for c in cuts])
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"__n_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__n_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__n_{k}" for k in keys])


def _with_cuts(
    df: DataFrame, strata: Sequence[str], key: str, wanted: DataFrame, among: DataFrame
) -> DataFrame:
    """Attach the cut keys found ``among`` some rows to all rows, as ``__cut_<name>``."""
    cuts = cut_keys(among, strata, key, wanted)
    renamed = cuts.withColumnsRenamed(
        {c: f"__n_{c}" if c in strata else f"__cut_{c}" for c in cuts.columns}
    )
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"__n_{s}")) for s in strata])
    return df.join(broadcast_if_small(renamed), same, "left").drop(*[f"__n_{s}" for s in strata])


def balanced_sample(df: DataFrame, split: str, label: str, record_id: str, seed: int) -> DataFrame:
    """All positives, and as many negatives from the same split.

    The frame is read several times, so pass a stored one.
    """
    keyed = df.withColumn("__key", seeded_key(seed, F.col(record_id)))
    wanted = keyed.groupBy(split).agg(F.count_if(F.col(label)).alias("negatives"))
    joined = _with_cuts(keyed, [split], "__key", wanted, keyed.filter(~F.col(label)))
    low = F.coalesce(F.col("__key") <= F.col("__cut_negatives"), F.lit(False))
    return joined.filter(F.col(label) | low).drop("__key", "__cut_negatives")


def stratified_row_split(
    df: DataFrame, label: str, record_id: str, shares: dict[str, float], seed: int
) -> DataFrame:
    """Row split with the same shares inside every label; the last split takes the rest.

    Cuts are rounded half to even per label. The frame is read several times,
    so pass a stored one.
    """
    keyed = df.withColumn("__key", seeded_key(seed, F.col(record_id)))
    sizes = keyed.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    *front, last = list(shares)
    targets, upto = [], 0.0
    for name in front:
        upto += shares[name]
        target = F.bround(F.col("__n") * F.lit(round(upto, 12)), 0).cast("bigint")
        targets.append(target.alias(name))
    joined = _with_cuts(keyed, [label], "__key", sizes.select(label, *targets), keyed)
    split = F.lit(last)
    for name in reversed(front):
        split = F.when(F.col("__key") <= F.col(f"__cut_{name}"), F.lit(name)).otherwise(split)
    return joined.withColumn("split", split).drop("__key", *[f"__cut_{n}" for n in front])


def seeded_order(df: DataFrame, record_id: str, seed: int) -> DataFrame:
    """Seeded shuffle as a total order."""
    return df.orderBy(seeded_key(seed, F.col(record_id)), record_id)


def lowest_per_label(df: DataFrame, label: str, record_id: str, k: int, seed: int) -> DataFrame:
    """The k records per label with the smallest seeded key.

    Spark keeps only k rows per label and task before the shuffle.
    """
    keyed = df.withColumn("selection_key", seeded_key(seed, F.col(record_id)))
    window = Window.partitionBy(label).orderBy("selection_key")
    return (
        keyed.withColumn("__rank", F.row_number().over(window))
        .filter(F.col("__rank") <= k)
        .drop("__rank")
    )


def keep_one(df: DataFrame, keys: Sequence[str], order: str, last: bool = False) -> DataFrame:
    """One record per key: the first, or the last, in ``order``.

    The choice is an aggregate, so copies of a key shrink before the shuffle.
    """
    names = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    one = df.groupBy(*keys).agg(pick(F.struct(*names), F.col(order)).alias("__one"))
    return one.select(*keys, "__one.*").select(*df.columns)


def key_multiplicity(df: DataFrame, key: str, expected: int) -> DataFrame:
    """Distinct keys, rows, and keys that do not occur ``expected`` times."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum("n").alias("rows"),
        F.min("n").alias("min_copies"),
        F.max("n").alias("max_copies"),
        F.count_if(F.col("n") != expected).alias("unexpected_keys"),
    )


def beyond(df: DataFrame, record_id: str) -> Callable[[Column, Column], Column]:
    """Fresh ids for :func:`replicated` that no record has, for ids from zero up."""
    step = df.agg(F.max(record_id) + 1).scalar()
    return lambda record, copy: record + copy * step


def replicated(
    df: DataFrame,
    record_id: str,
    copies: int,
    new_id: Callable[[Column, Column], Column],
    text: str | None = None,
    id_label: str = "",
) -> DataFrame:
    """Each record ``copies`` times; copy 0 keeps its id, the others get ``new_id``.

    When a text column is given, the id written behind ``id_label`` follows.
    """
    spread = df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    fresh = F.when(F.col("__copy") == 0, F.col(record_id)).otherwise(
        new_id(F.col(record_id), F.col("__copy"))
    )
    out = spread.withColumn("__fresh", fresh)
    if text is not None:
        old = F.concat(F.lit(id_label), F.col(record_id).cast("string"))
        new = F.concat(F.lit(id_label), F.col("__fresh").cast("string"))
        out = out.withColumn(text, F.replace(F.col(text), old, new))
    return out.withColumn(record_id, F.col("__fresh")).drop("__copy", "__fresh")


def weighted_union(natural: DataFrame, synthetic: DataFrame, weight: float) -> DataFrame:
    """Natural rows with weight one and synthetic rows with their own weight."""
    left = natural.withColumns(
        {"sample_source": F.lit("natural"), "sample_weight": F.lit(1.0)}
    )
    right = synthetic.withColumns(
        {"sample_source": F.lit("synthetic_boundary"), "sample_weight": F.lit(float(weight))}
    )
    return left.unionByName(right, allowMissingColumns=True)


def training_summary(df: DataFrame, label: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sample_source") == "natural").alias("natural"),
        F.count_if(F.col("sample_source") == "synthetic_boundary").alias("synthetic_boundary"),
        F.count_if(~label).alias("normal"),
        F.count_if(label).alias("anomaly"),
        F.sum("sample_weight").alias("weight_sum"),
    )


def fan_out(df: DataFrame, targets: dict[str, Column], out: str = "dataset") -> DataFrame:
    """One row per dataset a record belongs to."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in targets.items()]))
    return df.withColumn(out, F.explode(names))
