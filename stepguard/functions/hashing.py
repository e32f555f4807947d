"""Seeded pseudo-random keys that any engine can recompute."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2_147_483_647


def seeded_key(seed: int | str, identity: Column) -> Column:
    """``sha256("seed:id")`` as hex text; ordering by it is a seeded shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), identity.cast("string")), 256)


def leading_bits(hex_key: Column, digits: int) -> Column:
    """The first hex digits of a key as a whole number."""
    return F.conv(F.substring(hex_key, 1, digits), 16, 10).cast("bigint")


def seeded_integer(seed: int | str, identity: Column) -> Column:
    """A whole number in [0, MODULUS) from the seeded key."""
    return leading_bits(seeded_key(seed, identity), 8) % MODULUS


def mixed_integer(base: Column, trial: Column) -> Column:
    """A whole number in [0, MODULUS) for each (base, trial), by squaring modulo a prime.

    Every product stays below 2**62, so no engine overflows.
    """
    first = (base + trial * 40692) % MODULUS
    second = (first * first + 12345) % MODULUS
    return (second * second + base) % MODULUS


def mixed_integers(base: int | np.ndarray, trial: np.ndarray) -> np.ndarray:
    """The same numbers as :func:`mixed_integer`, for bases and trials as arrays that fit together."""
    first = (base + trial * 40692) % MODULUS
    second = (first * first + 12345) % MODULUS
    return (second * second + base) % MODULUS
