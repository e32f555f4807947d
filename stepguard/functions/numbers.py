"""Number coercion with the null rules of text-typed measurement records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def tolerant_number(column: Column) -> Column:
    """Text to double; null, blank and unparsable text become null.

    A trailing ``d`` or ``f`` is a Java number suffix and not part of a number here.
    """
    text = F.trim(column.cast("string"))
    return F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))


def finite_number(column: Column) -> Column:
    """Like :func:`tolerant_number`, and NaN or infinite values become null too."""
    return only_finite(tolerant_number(column))


def only_finite(number: Column) -> Column:
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def state_code(column: Column) -> Column:
    """Number text to a whole code, cut towards zero; null stays null."""
    return finite_number(column).try_cast("int")


def group_key(column: Column, missing: str = "missing") -> Column:
    return F.coalesce(column.cast("string"), F.lit(missing))


def typed_channels(df: DataFrame, channels: list[str], finite: bool = True) -> DataFrame:
    """Bring measurement channels to double, leaving numeric columns inside codegen."""
    types = dict(df.dtypes)

    def convert(name: str) -> Column:
        column = F.col(f"`{name}`")
        if types[name].split("(")[0] in NUMERIC_TYPES:
            number = column.cast("double")
            return only_finite(number) if finite else number
        return finite_number(column) if finite else tolerant_number(column)

    return df.withColumns({name: convert(name) for name in channels})


def one_hot(column: Column, values: list, prefix: str) -> dict[str, Column]:
    """0/1 columns for each value, and one for everything else including null."""
    flags = {
        f"{prefix}_{value}": column.eqNullSafe(F.lit(value)).cast("double") for value in values
    }
    flags[f"{prefix}_other"] = (~F.coalesce(column.isin(values), F.lit(False))).cast("double")
    return flags


def or_zero(number: Column) -> Column:
    return F.coalesce(number, F.lit(0.0))


def previous_or_current(previous: Column, current: Column) -> Column:
    """A missing previous value is filled with the current one, then with zero."""
    return F.coalesce(previous, current, F.lit(0.0))


def rate(part: Column, whole: Column, empty: float | None = None) -> Column:
    """``part / whole``; ``empty`` when the whole is zero."""
    value = F.when(whole != 0, part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))
