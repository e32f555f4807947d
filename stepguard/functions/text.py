"""Rendering rows to text and reading numbers back out of text."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNED_DECIMAL = r"([-+]?\d+(?:\.\d+)?)"
SIGNED_INTEGER = r"(-?\d+)"
BLANKS = " \t\r\x0b\x0c\u3000"


def fixed(number: Column, digits: int = 4, missing: str | None = None) -> Column:
    """Fixed-point text that rounds the stored binary value, as C and Python do.

    ``format_string('%.4f')`` rounds the shortest decimal form instead, so
    2.00005 would give 2.0001. The one value the number formatter rounds
    differently is half of the last digit, which is spelled out.
    """
    half = 5 * 10.0 ** -(digits + 1)
    pattern = "0." + "0" * digits if digits else "0"
    text = (
        F.when(number == half, F.lit(f"{half:.{digits}f}"))
        .when(number == -half, F.lit(f"{-half:.{digits}f}"))
        .otherwise(F.call_function("format_number", number, F.lit(pattern)))
    )
    return text if missing is None else F.coalesce(text, F.lit(missing))


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` marks of a template with text columns; a null field gives ''."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def named_values(columns: list[str], separator: str) -> Column:
    """``name<separator>value`` for every column that is not null, as an array."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"`{name}`").isNotNull(),
                    F.concat(F.lit(name + separator), F.col(f"`{name}`").cast("string")),
                )
                for name in columns
            ]
        )
    )


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    turns = [("system", system), ("user", user), ("assistant", assistant)]
    return F.array(
        *[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns]
    )


def insert_turns(messages: Column, turns: Column | None) -> Column:
    """Drop the answer and put example turns between the system and the target turn."""
    if turns is None:
        return F.slice(messages, 1, 2)
    return F.concat(F.slice(messages, 1, 1), turns, F.slice(messages, 2, 1))


def keep_lines(text: Column, prefixes: list[str]) -> Column:
    """The trimmed lines that start with a known prefix, null unless all are there."""

    def known(line: Column) -> Column:
        hit = line.startswith(F.lit(prefixes[0]))
        for prefix in prefixes[1:]:
            hit = hit | line.startswith(F.lit(prefix))
        return hit

    stripped = F.transform(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS)))
    lines = F.filter(stripped, known)
    return F.when(F.size(lines) == len(prefixes), F.array_join(lines, "\n"))


def first_match(text: Column, patterns: list[str], kind: str = "double") -> Column:
    """The first pattern in list order whose group one reads as a number."""
    return F.coalesce(
        *[F.regexp_extract(text, pattern, 1).try_cast(kind) for pattern in patterns]
    )


def first_labelled(
    text: Column, labels: list[str], number: str = SIGNED_DECIMAL, kind: str = "double"
) -> Column:
    """The number behind the first label, in list order, that has one.

    The colon may be ASCII or full-width. A pattern only runs when its label
    occurs at all, which a byte search tells faster; a miss would also cost an
    exception inside the cast of the empty result.
    """

    def behind(label: str) -> Column:
        pattern = rf"{re.escape(label)}[:：]\s*{number}"
        found = F.regexp_extract(text, pattern, 1).try_cast(kind)
        return F.when(F.contains(text, F.lit(label)), found)

    return F.coalesce(*[behind(label) for label in labels])


def labelled_number(text: Column, label: str, unit: str, missing: str | None = None) -> Column:
    """``label：number unit``; the missing marker in place of the number gives null."""
    body = r"([+-]?[0-9.]+)"
    if missing is not None:
        body = rf"(?:{re.escape(missing)}|{body})"
    pattern = rf"{re.escape(label)}：{body}\s*{re.escape(unit)}"
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def record_id_in(text: Column, label: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"{re.escape(label)}：(\d+)", 1), F.lit(""))


def masked(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Blank out parts that do not count for identity, in list order."""
    for pattern, replacement in replacements:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def identity_key(*parts: Column) -> Column:
    """One fixed-length key for a tuple of texts; null parts stay distinct from ''."""
    names = [f"p{i}" for i in range(len(parts))]
    return F.sha2(
        F.to_json(
            F.struct(*[part.alias(name) for name, part in zip(names, parts)]),
            {"ignoreNullFields": "false"},
        ),
        256,
    )
