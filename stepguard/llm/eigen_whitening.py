"""Whitening of vectors by components found through FEAST contour integration.

Each entry becomes a whole number, ``floor(64 * c) + 1000000``. Three passes over the
vectors, each a sum of one small partial result per partition, give the sums, the
covariance and, at the end, the covariance of what was whitened; the last pass
returns the rows. Sums of whole numbers are exact: entries are centred by the whole
number next to their mean before they are multiplied, and what the rounding of the
mean leaves is taken off in whole numbers, too.

The covariance is as large as the vectors are long, whatever the number of rows. Its
spectrum is cut into intervals: the inertia of the shifted matrix, read from the signs
of a Sturm sequence, says how many eigenvalues lie below a cut, and cuts are placed
where none is near. Each interval is a row of its own, solved in a task: random vectors
are filtered by a Gauss-Legendre quadrature of ``(z - V)^-1`` along a circle around the
interval, a Rayleigh-Ritz step extracts components from what passes, and both repeat
until the residuals reach rounding. An interval must give as many components as its
inertia counts say; else its basis grows, up to the whole space.

Rows with a null vector or null or non-finite entries are left out, and so are vectors
without entries. Vectors of another length than the most frequent (of equally frequent
ones the longest) have no place in that space and take no part. Repeated rows and rows
with a null id are rows like others. A component without variance can't be whitened:
its ``whitened`` is null, and ``identity_error`` is over the others (null if there are
none). ``deviation`` is exact; it is null where it doesn't fit in 64 bits. Without rows
the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepguard.llm.hard_negatives import quantised, usable

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues that an interval holds at most, but for clusters that no cut parts.
IN_INTERVAL = 8
NODES = 12
ROUNDS = 40
RESIDUAL = 2e-15
#: Eigenvalues below this part of the largest count as zero.
ZERO = 1e-12
#: Rows of the result that are made at a time.
OUT_ROWS = 1 << 18
EXACT = 2**53
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- sums over all rows -------------------------------------------------------------


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    codes = batch.column("codes")
    return codes.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(rows: np.ndarray) -> np.ndarray:
    """The number of rows, then the sum of each dimension."""
    return np.concatenate([[len(rows)], rows.sum(axis=0)])


def _products(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of dimensions, upper triangle, exact."""
    y = rows - centre
    largest = max(int(y.max(initial=0)), -int(y.min(initial=0)), 1)
    upper = np.triu_indices(y.shape[1])
    if largest * largest >= EXACT:
        whole = y.astype(object)
        return (whole.T @ whole)[upper]
    step = EXACT // (largest * largest)  # floating-point products of so many rows are exact
    total = np.zeros(len(upper[0]), dtype=object if len(y) * largest**2 >= 2**63 else np.int64)
    for first in range(0, len(y), step):
        part = y[first : first + step].astype(np.float64)
        total += (part.T @ part)[upper].astype(np.int64)
    return total


def _whitened_sums(rows: np.ndarray, whiten: Callable) -> np.ndarray:
    """Sums and sums of products of what is whitened; its mean is zero, so nothing cancels."""
    z = whiten(rows)
    return np.concatenate([z.sum(axis=0), (z.T @ z)[np.triu_indices(z.shape[1])]])


def totals(codes: DataFrame, terms: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """The sum over all rows of a vector of terms, in the order of the terms.

    A partition returns one number per term; those of whole numbers are added as
    decimals, so they don't overflow.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                found = terms(_matrix(batch))
                if kind != "double":
                    found = found.astype(object)
                held = found if held is None else held + found
        if held is not None:
            values = held.tolist() if kind == "double" else [str(v) for v in held]
            yield pa.RecordBatch.from_pydict(
                {"place": pa.array(range(len(values)), pa.int64()), "value": pa.array(values)}
            )

    rows = (
        codes.mapInArrow(partial, f"place long, value {'double' if kind == 'double' else 'string'}")
        .groupBy("place")
        .agg(F.sum(F.col("value").cast(kind)).alias("value"))
        .collect()
    )
    found = {r["place"]: r["value"] if kind == "double" else int(r["value"]) for r in rows}
    return [found[place] for place in range(len(found))]


def covariance(n: int, sums: list[int], centre: list[int], products: list[int]) -> np.ndarray:
    """Divisor n, from whole numbers: each entry is rounded once."""
    d = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    found = np.zeros((d, d))
    for value, i, j in zip(products, *np.triu_indices(d), strict=True):
        found[i, j] = found[j, i] = (n * value - rest[i] * rest[j]) / (n * n)
    return found


# --- components ---------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar matrix, by reflections."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length:
            v /= length
            a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: the number of eigenvalues below each shift."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - shifts - e * e / pivot
        below += pivot < 0
    return below


def intervals(below: Callable[[np.ndarray], np.ndarray], wanted: int, most: int = IN_INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals with their counts that hold the ``wanted`` largest eigenvalues, of -1 to 1."""
    found, held, stack = [], 0, [(-1.0078125, 1.0078125)]
    while stack and held < wanted:
        low, high = stack.pop()
        count = int(np.diff(below(np.array([low, high])))[0])
        cut = _cut(below, low, high) if count > most else None
        if count and cut is None:
            found.append((low, high, count))
            held += count
        elif count:
            stack += [(low, cut), (cut, high)]  # the upper one comes next
    return found


def _cut(below: Callable[[np.ndarray], np.ndarray], low: float, high: float) -> float | None:
    """A place near the middle with no eigenvalue around; None where there is none."""
    for cells in (32, 256, 2048):
        edges = np.linspace(low, high, cells + 1)
        counts = below(edges)
        # cells without eigenvalues, with some on both sides
        clear = np.flatnonzero((np.diff(counts) == 0) & (counts[:-1] > counts[0]) & (counts[1:] < counts[-1]))
        if len(clear):
            at = clear[np.argmin(np.abs(2 * counts[clear] - counts[0] - counts[-1]))]
            return float((edges[at] + edges[at + 1]) / 2)
        holding = np.flatnonzero(np.diff(counts) > 0)
        if len(holding) == 1:  # all in one cell: look closer
            low, high = float(edges[holding[0]]), float(edges[holding[0] + 1])
    return None


def components_of(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs with values between ``low`` and ``high``, by filtered subspaces."""
    d = len(matrix)
    angles, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (1 - angles))  # the upper half of the circle; the lower one is conjugate
    centre, radius, size = (low + high) / 2, (high - low) / 2, min(d, count + max(4, count // 2))
    while True:
        basis = np.random.default_rng(seed).standard_normal((d, size))
        least = np.inf
        for _ in range(ROUNDS):
            passed = np.zeros_like(basis)
            for turn, weight in zip(turns, weights, strict=True):
                shifted = (centre + radius * turn) * np.eye(d) - matrix
                passed += 0.5 * weight * (radius * turn * np.linalg.solve(shifted, basis.astype(complex))).real
            orthonormal = np.linalg.qr(passed)[0]
            values, turned = np.linalg.eigh(orthonormal.T @ matrix @ orthonormal)
            basis = orthonormal @ turned
            residuals = np.linalg.norm(matrix @ basis - basis * values, axis=0)
            inside = np.flatnonzero((values > low) & (values < high))
            inside = inside[np.argsort(residuals[inside])][:count]
            worst = residuals[inside].max(initial=0) if len(inside) == count else np.inf
            if worst <= RESIDUAL * d**0.5 or (worst < 1e-12 and worst > least / 2):
                return values[inside], basis[:, inside]
            least = min(least, worst)
        if size == d:
            raise ArithmeticError(f"{count} eigenvalues counted between {low} and {high}, {len(inside)} found")
        size = min(d, 2 * size)


def principal_components(spark: SparkSession, matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as rows; an interval is a task."""
    wanted = min(wanted, len(matrix))
    norm = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    shared = spark.sparkContext.broadcast(matrix / norm)
    diagonal, off = tridiagonal(shared.value)
    cuts = intervals(lambda s: count_below(diagonal, off, s), wanted)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high, count in batch.itertuples(index=False):
                values, vectors = components_of(shared.value, low, high, count)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    frame = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts))
    found = frame.mapInPandas(solved, "value double, vector array<double>").collect()
    found.sort(key=lambda r: -r["value"])
    values = np.array([r["value"] for r in found[:wanted]]) * norm
    return values, np.array([r["vector"] for r in found[:wanted]])


# --- rows ---------------------------------------------------------------------------


def deviations(rows: np.ndarray, n: int, centre: np.ndarray, rest: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - sum)^2 for each row."""
    y = rows - centre
    largest = n * max(int(y.max(initial=0)), -int(y.min(initial=0))) + max(map(abs, rest))
    if y.shape[1] * largest * largest < 2**63:
        part = n * y - np.array(rest, dtype=np.int64)
        return pa.array((part * part).sum(axis=1))
    part = n * y.astype(object) - np.array(rest, dtype=object)
    return pa.array([v if v < 2**63 else None for v in (part * part).sum(axis=1)], pa.int64())


def whitened_rows(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS,
    scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """A row per vector and component, see ``SCHEMA``; the id column is returned as ``vec_id``."""
    spark, vector = rows.sparkSession, F.col(f"`{vector_col}`")
    taken = rows.filter(usable(vector)).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(quantised(vector, scale), lambda x: x + F.lit(offset)).alias("codes"),
    )
    length = (
        taken.groupBy(F.size("codes").alias("length")).count().filter("length > 0")
        .orderBy(F.desc("count"), F.desc("length")).first()
    )
    if length is None:
        return spark.createDataFrame([], SCHEMA)
    taken = taken.filter(F.size("codes") == length["length"])
    codes = taken.select("codes")

    n, *sums = totals(codes, _sums, "decimal(38,0)")
    means = [round(s / n) for s in sums]
    centre = np.array(means, dtype=np.int64)
    rest = [s - n * c for s, c in zip(sums, means, strict=True)]
    matrix = covariance(n, sums, means, totals(codes, lambda x: _products(x, centre), "decimal(38,0)"))
    values, vectors = principal_components(spark, matrix, wanted)
    good = values > ZERO * values[0] if values[0] > 0 else np.zeros(len(values), dtype=bool)
    onto = (vectors[good] / np.sqrt(values[good])[:, None]).T
    remainder = np.array([r / n for r in rest])

    def whiten(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - remainder) @ onto

    k, trace = int(good.sum()), float(np.trace(matrix))
    error = None
    if k:
        found = np.array(totals(codes, lambda x: _whitened_sums(x, whiten), "double"))
        mean, spread = found[:k] / n, np.zeros((k, k))
        spread[np.triu_indices(k)] = found[k:] / n
        error = float(np.abs(np.triu(spread - np.outer(mean, mean) - np.eye(k))).max())
    explained = [float(v) / trace if trace else None for v in np.maximum(values, 0)]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, many = max(1, OUT_ROWS // len(values)), len(values)
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                x = _matrix(batch)
                z = np.full((len(x), many), np.nan)
                z[:, good] = whiten(x)
                each = pa.array(np.repeat(np.arange(len(x)), many))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": batch.column("vec_id").take(each),
                        "component": pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(each), n, dtype=np.int64)),
                        "deviation": deviations(x, n, centre, rest).take(each),
                        "whitened": pa.array(z.ravel(), mask=np.tile(~good, len(x))),
                        "explained": pa.array(explained * len(x), pa.float64()),
                        "identity_error": pa.array([error] * len(each), pa.float64()),
                    }
                )

    return taken.mapInArrow(told, SCHEMA)


def whitening_digest(rows: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return whitened_rows(rows)
