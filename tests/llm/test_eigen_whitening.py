import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepguard.llm import eigen_whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def made_up(n=300, width=40, seed=3):
    rng = np.random.default_rng(seed)
    spread = rng.standard_normal((width, width)) * np.linspace(2, 0.1, width)
    rows = [(i, [float(np.float32(x)) for x in spread @ rng.standard_normal(width)], 0) for i in range(n)]
    rows += [rows[4]] * 50 + [(None, rows[5][1], 1)]
    return rows + [
        (900, None, 1), (901, [None] + [0.0] * (width - 1), 1), (902, [float("nan")] * width, 1),
        (903, [float("inf")] * width, 1), (904, [], 1), (905, [1.0, 2.0], 1),
    ]


def plain(rows, width):
    """By numpy's eigenvalues and exact sums: vec_id -> deviation, whitened without signs; values, trace."""
    kept = [(k, v) for k, v, _ in rows if v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    codes = [[math.floor(64 * x) + 1_000_000 for x in v] for _, v in kept]
    n, sums = len(codes), [sum(c) for c in zip(*codes)]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(c, sums)) for c in codes]
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(c, sums)] for c in codes])
    matrix = centred.T @ centred / n
    values, vectors = np.linalg.eigh(matrix)
    return [k for k, _ in kept], n, deviation, centred @ vectors[:, ::-1], values[::-1], np.trace(matrix)


@pytest.mark.parametrize("width", [40, 3])
def test_against_numpy(spark, width):
    rows = made_up(width=width)
    keys, n, deviation, projected, values, trace = plain(rows, width)
    count = min(32, width)
    frame = W.whitening_digest(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = frame.collect()
    assert len(got) == len(keys) * count and frame.columns == [f.split()[0] for f in W.SCHEMA.split(", ")]
    wanted = sorted(
        (str(k), c + 1, d, abs(float(p[c] / values[c] ** 0.5))) for k, d, p in zip(keys, deviation, projected) for c in range(count)
    )
    found = sorted((str(r.vec_id), r.component, r.deviation, abs(r.whitened)) for r in got)
    assert [w[:3] for w in wanted] == [f[:3] for f in found]
    assert max(abs(a[3] - b[3]) for a, b in zip(wanted, found)) < 1e-9
    assert {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error}
    assert got[0].identity_error < 1e-10
    for r in got:
        assert abs(r.explained * trace / values[r.component - 1] - 1) < 1e-9


def spectra():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 64, 100):
        x = rng.standard_normal((d, d))
        yield f"random {d}", x + x.T
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    yield "clusters", q @ np.diag([5.0] * 20 + [3.0] * 20 + [1e-9] * 24) @ q.T
    yield "falling", q @ np.diag(2.0 ** -np.arange(64)) @ q.T
    yield "near pairs", q @ np.diag(np.repeat(np.arange(1.0, 33), 2) + np.tile([0, 1e-7], 32)) @ q.T
    yield "zero", np.zeros((9, 9))
    yield "one value", np.eye(40)


@pytest.mark.parametrize("name,matrix", list(spectra()))
def test_contours_find_all(name, matrix):
    a = matrix / (np.abs(matrix).sum(axis=1).max() or 1)
    diagonal, off = W.tridiagonal(a)
    exact = np.linalg.eigvalsh(a)
    shifts = np.linspace(-1.1, 1.1, 57) + 1e-5
    assert W.count_below(diagonal, off, shifts).tolist() == [int((exact < s).sum()) for s in shifts]
    cuts = W.intervals(lambda s: W.count_below(diagonal, off, s), len(a))
    assert sum(c for *_, c in cuts) == len(a)
    pairs = [W.components_of(a, *cut) for cut in cuts]
    values, vectors = np.concatenate([v for v, _ in pairs]), np.concatenate([x for _, x in pairs], axis=1)
    assert np.abs(np.sort(values) - exact).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-7
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        W.components_of(np.diag([0.1, 0.2, 0.9]), 0.0, 0.5, 3)


def test_no_variance(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i), 2.0], 0) for i in range(4)], SCHEMA)
    got = {(r.vec_id, r.component): r for r in W.whitening_digest(frame).collect()}
    assert all((r.whitened is None) == (c > 1) for (_, c), r in got.items()) and len(got) == 12
    assert abs(got[0, 1].explained - 1) < 1e-12 and got[0, 2].explained < 1e-12 and got[0, 1].identity_error < 1e-12
    one = W.whitening_digest(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(None, None, 0, None)] * 2


def test_exact_sums():
    rng = np.random.default_rng(0)
    for size in (10, 2**20, 2**30, 2**40):
        rows = rng.integers(-size, size, (50, 4))
        centre = rng.integers(-size, size, 4)
        whole = rows.astype(object) - centre.astype(object)
        assert W._products(rows, centre).tolist() == (whole.T @ whole)[np.triu_indices(4)].tolist()
        rest = [3, -2, 0, 7]
        for n in (1, 5, 10**6):
            found = W.deviations(rows, n, centre, rest).to_pylist()
            exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in whole]
            assert found == [v if v < 2**63 else None for v in exact]


def test_odd_tables(spark):
    assert W.whitening_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whitening_digest(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).count() == 0
    frame = spark.createDataFrame(made_up(50, 3), SCHEMA)
    clashing = frame.select("*", *[F.lit("mine").alias(c) for c in "codes component n deviation whitened length place".split()])
    assert clashing.count() == frame.count()
    assert W.whitening_digest(clashing).count() == W.whitening_digest(frame).count() > 0
