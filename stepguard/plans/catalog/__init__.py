"""Queries over the test tables, each with the SQL it must agree with."""

from stepguard.plans.catalog import (  # noqa: F401
    datasets,
    evaluation,
    files,
    models,
    profiles,
    rules,
    streams,
    texts,
)
from stepguard.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
