"""Secrets in texts: fixed patterns, and tokens that look drawn at random.

Patterns find what has a telling form. For the rest, runs of 16 or more token
characters are tested (``=`` only as padding at their end). A token can stand behind a
path or a name in its run, so up to three forms of a run are candidates: the whole
run, its core without the words that ``/``, ``+``, ``-`` and ``_`` set apart at its
ends, and each part of 16 or more between two of these. The encoding of a candidate is
inferred (hexadecimal, base 32, lower-case base 36, base 62 or base 64), and a battery
is run on its characters:

* chi-squared against equal use of the encoding's alphabet,
* the number of runs above and below the middle of the alphabet,
* the serial correlation of neighbouring characters.

Two questions are asked. Is the token *unlike ordinary text*? Its chi-squared is
compared with what characters drawn with the frequencies of ordinary tokens give
at this length; the lower tail is the p-value of "ordinary". And is it *like
random characters*? None of the three tests may reject that at ``PLAIN``.

How far the first p-value reaches depends on the length, so false discoveries are
controlled by class of length: over all candidates of all documents, the largest
cut is taken in each class at which at most ``RATE`` of the tokens below it would
be ordinary (Benjamini-Hochberg). P-values are counted in bins of a tenth of a
power of ten and enter as the upper end of their bin, so what is gathered stays a
few hundred rows for any input, and does not depend on how rows are split. All forms
of a run count as tested. Of a run's discoveries the core is reported, else the whole
run, else its parts; spans never overlap.

Letters of one case (first letter apart), and digits alone, are words and numbers:
no encoding is inferred. Null text counts as empty. Repeated rows are scanned each
by itself, but count as candidates each, too.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.llm.common import text_slices
from stepguard.session import checkpointed

# The patterns and how many characters they need.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?")
PIECE = re.compile(r"[A-Za-z0-9]+=*")
WORD = re.compile(r"(?:[A-Za-z]?[a-z]*|[A-Z]+|(?:[a-z]{2,})?(?:[A-Z][a-z]{2,})+)[0-9]{0,2}|[0-9]+", re.ASCII)
#: Fewer characters before or behind a core could well be the token's own.
LEAST_TRIM = 4
LEAST = 16
LETTERS = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+", re.ASCII)

# Encodings in the order in which they are tried: name, alphabet, and the sums of
# the second and third powers of the shares that ordinary tokens give its
# characters (letters as in prose of European languages, digits as in dates and
# counters, both mixed for alphabets that hold both).
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", 0.105, 0.0150),
    ("hex", _DIGITS + "ABCDEF", 0.105, 0.0150),
    ("base32", _UPPER + "234567", 0.066, 0.0056),
    ("base36", _DIGITS + _LOWER, 0.066, 0.0056),
    ("base62", _DIGITS + _UPPER + _LOWER, 0.066, 0.0056),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", 0.066, 0.0056),
    ("base64", _UPPER + _LOWER + _DIGITS + "-_", 0.066, 0.0056),
)

RATE = 0.05
PLAIN = 1e-3
BINS = 400
CLASSES = (20, 28, 40, 64)  # lengths from which a new class begins


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def candidates(text: str) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each run the spans of its core and of the whole run, and those of its parts."""
    runs = []
    for m in CANDIDATE.finditer(text):
        start, end = whole = m.span()
        pieces = [piece.span() for piece in PIECE.finditer(text, *whole)]
        first, last = 0, len(pieces)
        while first < last and WORD.fullmatch(text, *pieces[first]):
            first += 1
        while first < last and WORD.fullmatch(text, *pieces[last - 1]):
            last -= 1
        if first == last:
            runs.append(([whole], []))
            continue
        if pieces[first][0] - start >= LEAST_TRIM:
            start = pieces[first][0]
        if end - pieces[last - 1][1] >= LEAST_TRIM:
            end = pieces[last - 1][1]
        outer = [whole] if (start, end) == whole else [(start, end), whole]
        parts = [p for p in pieces[first:last] if p[1] - p[0] >= LEAST and p not in outer]
        runs.append((outer, parts))
    return runs


def battery(token: str) -> tuple[float, float] | None:
    """P-values of "ordinary" and of "random", or None if no encoding fits."""
    body = token.rstrip("=")
    if len(body) < LEAST or LETTERS.fullmatch(body):
        return None
    used = set(body)
    for _, alphabet, second, third in ENCODINGS:
        if used <= set(alphabet):
            break
    else:
        return None
    n, k = len(body), len(alphabet)
    place = np.array([alphabet.index(c) for c in body])
    counts = np.bincount(place, minlength=k)
    chi = float((counts.astype(float) ** 2).sum()) * k / n - n
    # uniformity: mean and variance of the statistic are exact at any length
    even = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    # ordinary characters: the statistic's mean is exact, its variance leading terms
    mean = (n - 1) * (k * second - 1) + k - 1
    spread = 4 * n * k * k * (third - second * second) + 2 * k * k * second * second
    ordinary = upper_tail((mean - chi) / math.sqrt(spread))
    above = place >= k / 2
    ups = int(above.sum())
    tests = [upper_tail(even)]
    if 0 < ups < n:
        expected = 1 + 2 * ups * (n - ups) / n
        variance = (expected - 1) * (expected - 2) / (n - 1)
        runs = 1 + int((above[1:] != above[:-1]).sum())
        if variance > 0:
            tests.append(2 * upper_tail(abs(runs - expected) / math.sqrt(variance)))
    else:
        tests.append(2.0 ** (1 - n))
    centred = place - place.mean()
    power = float((centred * centred).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    tests.append(2 * upper_tail(abs(serial + 1 / n) * math.sqrt(n)))
    return ordinary, min(1.0, len(tests) * min(tests))


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind, kind:start:end) of the fixed patterns, in order."""
    found = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(word in low for word in ("passw", "secret", "token", "key", "api")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_CHARS:
                found.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_CHARS:
                found.append((m.start(), m.end(), 1))
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def length_class(n: int) -> int:
    return sum(n >= start for start in CLASSES)


def covered(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans in order, overlapping ones merged."""
    starts, ends = [], []
    for start, end, _ in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def scan(text: str) -> tuple:
    """Spans of the patterns, and the tested forms of each run: (core and whole, parts)."""
    base = pattern_spans(text)
    starts, ends = covered(base)

    def tested(spans: list[tuple[int, int]]) -> list[tuple]:
        rows = []
        for start, end in spans:
            after = bisect_right(ends, start)
            if after < len(starts) and starts[after] < end:
                continue
            values = battery(text[start:end])
            if values is not None:
                ordinary, random = values
                # the bin's upper end is at least the p-value
                place = BINS if ordinary <= 0 else min(BINS, int(-10 * math.log10(ordinary)))
                rows.append((start, end, length_class(end - start), place, random >= PLAIN))
        return rows

    runs = [(tested(outer), tested(parts)) for outer, parts in candidates(text)]
    return base, [run for run in runs if run[0] or run[1]]


FORMS = "array<struct<start:int,end:int,class:int,bin:int,random:boolean>>"


def with_candidates(text: Column) -> Column:
    """What one pass over a text finds; ``runs`` wait for the cuts of all documents."""

    @F.pandas_udf(
        f"base array<struct<start:int,end:int,kind:int>>, runs array<struct<outer:{FORMS},parts:{FORMS}>>"
    )
    def found(batch: pd.Series) -> pd.DataFrame:
        rows = [scan(text) for _, part in text_slices(batch) for text in part]
        return pd.DataFrame(rows, columns=["base", "runs"])

    return found(text)


def cuts(counts: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """For each class of length the lowest bin that is a discovery.

    ``counts`` has (class, bin, tokens). Bin b holds p-values up to 10**(-b/10).
    """
    by_class: dict[int, dict[int, int]] = {}
    for kind, place, n in counts:
        by_class.setdefault(kind, {})[place] = by_class.get(kind, {}).get(place, 0) + n
    lowest = {}
    for kind, bins in by_class.items():
        total, below = sum(bins.values()), 0
        for place in sorted(bins, reverse=True):
            below += bins[place]
            if total * 10 ** (-place / 10) <= rate * below:
                lowest[kind] = place
    return lowest


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans`` of (start, end, kind, number of the kind).

    Stored once in the shared folder between the scan and the cuts.
    """
    scanned = checkpointed(
        docs.select(
            F.col(id_col).alias("id"), with_candidates(F.col(text_col)).alias("found")
        ).select("id", "found.base", "found.runs")
    )
    forms = F.flatten(F.transform("runs", lambda r: F.concat(r["outer"], r["parts"])))
    counted = (
        scanned.select(F.inline(forms)).groupBy("class", "bin").count().collect()
    )  # a few classes times BINS rows
    lowest = cuts([tuple(row) for row in counted])
    least = F.create_map(*[F.lit(x) for kv in (lowest or {-1: 0}).items() for x in kv])

    def discovered(forms: Column) -> Column:
        return F.filter(
            forms,
            lambda t: t["random"] & (t["bin"] >= F.coalesce(least[t["class"]], F.lit(BINS + 1))),
        )

    kept = F.transform(
        "runs", lambda r: F.struct(discovered(r["outer"]).alias("outer"), discovered(r["parts"]).alias("parts"))
    )
    chosen = F.flatten(
        F.transform(
            kept, lambda r: F.when(F.size(r["outer"]) > 0, F.slice(r["outer"], 1, 1)).otherwise(r["parts"])
        )
    )
    spans = F.concat(
        F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"])),
        F.transform(
            chosen, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))
        ),
    )
    return scanned.select(F.col("id").alias(id_col), F.array_sort(spans).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return find_secrets(docs).select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
        number(3).alias("n_random"),
    )
