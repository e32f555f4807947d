"""From typed records to split, balanced training data on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepguard.operators import profile as pf
from stepguard.operators.sampling import (
    balanced_sample,
    keep_one,
    key_multiplicity,
    seeded_order,
    weighted_union,
)
from stepguard.operators.splits import (
    SPLITS,
    set_overlap,
    split_ranges,
    stratified_group_split,
    with_split,
)
from stepguard.plans import cycler as cy
from stepguard.sources.manifest import fingerprints
from stepguard.sources.writers import land, write_jsonl

SEED = 20260725
OUTPUT = ["messages", "is_anomaly", "record_id", "cycle_no", "split", "rule_triggers"]


@dataclass(frozen=True)
class BuiltDataset:
    labelled: DataFrame
    design: DataFrame
    statistics: DataFrame
    balanced: dict[str, str]
    natural_test: str
    manifest: DataFrame


def build_dataset(
    records: DataFrame, out: str, trials: int = 60_000, seed: int = SEED
) -> BuiltDataset:
    """Label, split by cycle, balance and write.

    ``records`` is the output of :func:`stepguard.plans.cycler.records`. Every
    part goes to its own folder below ``out`` and an existing folder stops the
    job. The labelled rows are stored once and every later step reads them; the
    manifest is written last, so its presence marks a whole result.
    """
    labelled = land(cy.labelled(records), f"{out}/labelled")
    profiles = land(
        pf.group_profile(labelled, "cycle_no", "record_id", "ts", "is_anomaly"), f"{out}/profiles"
    )
    design = land(
        stratified_group_split(profiles, "cycle_no", trials, seed=seed), f"{out}/design"
    )
    placed = land(with_split(labelled, design, "cycle_no"), f"{out}/placed", ["split"])
    _check_counts(placed)

    natural = f"{out}/test_natural"
    write_jsonl(cy.natural_samples(placed.filter("split = 'test'")).select(*OUTPUT), natural)
    chosen = land(
        balanced_sample(placed, "split", "is_anomaly", "record_id", seed), f"{out}/chosen", ["split"]
    )
    balanced = {}
    for name in SPLITS:
        balanced[name] = f"{out}/{name}_balanced"
        # Ordering comes first, so that texts are rendered after the shuffle.
        ordered = seeded_order(chosen.filter(F.col("split") == name), "record_id", seed)
        write_jsonl(cy.natural_samples(ordered).select(*OUTPUT), balanced[name])

    files = fingerprints(labelled.sparkSession, f"{out}/{{test_natural,*_balanced}}/part-*")
    manifest = land(files, f"{out}/manifest")
    return BuiltDataset(
        labelled, design, pf.split_statistics(design), balanced, natural, manifest
    )


def _check_counts(placed: DataFrame) -> None:
    """Every split needs at least as many negatives as positives."""
    short = (
        split_ranges(placed, "split", "is_anomaly", "record_id", "ts")
        .filter("normal < anomaly")
        .select("split")
        .collect()
    )
    if short:
        raise ValueError(f"too few normal rows to balance: {[r['split'] for r in short]}")


def boundary_mixes(
    natural: DataFrame, boundary: DataFrame, tests: DataFrame, weight: float = 3.0, copies: int = 3
) -> dict[str, DataFrame]:
    """Two training sets that give boundary cases the same total weight.

    ``pure_augmentation`` holds every copy of a scenario with weight one,
    ``boundary_weighted`` one copy with ``weight``. Every scenario must occur
    ``copies`` times, and no question may also be a test question.
    """
    keyed = boundary.withColumn("key", cy.scenario_key(F.col("messages"), F.col("case_type")))
    check = key_multiplicity(keyed, "key", copies).first()
    if check["unexpected_keys"]:
        raise ValueError(f"{check['unexpected_keys']} scenarios do not occur {copies} times")
    signature = cy.question_signature(F.col("messages")).alias("signature")
    shared = set_overlap(boundary.select(signature), tests.select(signature)).first()["shared"]
    if shared:
        raise ValueError(f"{shared} training questions are test questions")

    def as_training(cases: DataFrame) -> DataFrame:
        return cases.withColumns(
            {
                "is_anomaly": F.col("gold"),
                "cycle_no": F.lit(None).cast("string"),
                "split": F.lit("train"),
            }
        ).drop("gold", "key")

    single = keep_one(keyed, ["key"], "record_id")
    return {
        "pure_augmentation": weighted_union(natural, as_training(boundary), 1.0),
        "boundary_weighted": weighted_union(natural, as_training(single), weight),
    }
