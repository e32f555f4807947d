"""Verdicts read from answers and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verdict(
    text: Column, positive: str, negative: str, head: int, exclusive: bool
) -> Column:
    """Answer text to true, false or null.

    The first word decides. Otherwise the first ``head`` characters are searched:
    positive needs the negative word to be absent, and negative needs the
    positive word to be absent only when ``exclusive``.
    """
    stripped = F.regexp_replace(text, r"(?U)^\s+", "")
    front = F.substring(stripped, 1, head)
    has_positive = F.contains(front, F.lit(positive))
    has_negative = F.contains(front, F.lit(negative))
    says_negative = has_negative & ~has_positive if exclusive else has_negative
    return (
        F.when(stripped.startswith(positive), F.lit(True))
        .when(stripped.startswith(negative), F.lit(False))
        .when(has_positive & ~has_negative, F.lit(True))
        .when(says_negative, F.lit(False))
    )


def two_class_score(positive_logp: Column, negative_logp: Column) -> Column:
    """Probability of the positive class from two log-probabilities.

    The exponent is kept at or below zero so that it cannot overflow.
    """
    gap = positive_logp - negative_logp
    small = F.exp(-F.abs(gap))
    return F.when(gap >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def passes(score: Column, threshold: float | Column) -> Column:
    """Inclusive: a score on the threshold is positive."""
    return score >= threshold


# Names of the ways in which a final verdict comes about.
UNPARSED = "llm_unparsed_use_rule"
CONSISTENT = "consistent"
CORRECTED = "corrected_by_rule"


def reconcile(model: Column, rule: Column) -> tuple[Column, Column]:
    """Final verdict and how it came about; the rule wins wherever they differ."""
    final = F.when(model.isNull(), rule).when(model == rule, model).otherwise(rule)
    kind = (
        F.when(model.isNull(), F.lit(UNPARSED))
        .when(model == rule, F.lit(CONSISTENT))
        .otherwise(F.lit(CORRECTED))
    )
    return final, kind


def required_label(*candidates: Column) -> Column:
    """The first label present; a row without any label stops the job."""
    return F.coalesce(*candidates, F.raise_error(F.lit("row has no label")).cast("boolean"))


def strict_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return (
        F.when(word.isin("true", "1"), F.lit(True))
        .when(word.isin("false", "0"), F.lit(False))
        .otherwise(
            F.raise_error(F.concat(F.lit("not a boolean value: "), F.coalesce(text, F.lit("null"))))
            .cast("boolean")
        )
    )
