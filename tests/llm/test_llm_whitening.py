"""Components by Jacobi-Davidson against a full eigendecomposition, exact figures against Python's integers."""

import math
import random

import numpy as np
import pytest

from barline.llm import whitening


@pytest.mark.parametrize("kind", ("flat", "falling", "clusters", "low rank"))
def test_eigenpairs(kind):
    rng = np.random.default_rng(2)
    d = 150
    spectrum = {
        "flat": np.linspace(90, 45, d),
        "falling": 1000.0 * 0.8 ** np.arange(d),
        "clusters": np.repeat(np.array([50.0, 49.99999, 20.0, 1.0, 0.5]), 30),
        "low rank": np.where(np.arange(d) < 20, 30.0 - np.arange(d), 0.0),
    }[kind]
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = basis * spectrum @ basis.T
    passes = []

    def product(v):
        passes.append(v.shape[1])
        return a @ v

    values, vectors = whitening.jacobi_davidson(product, d, 32)
    assert np.allclose(values, np.sort(spectrum)[::-1][:32], rtol=0, atol=1e-11 * spectrum.max())
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * spectrum.max()
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12
    assert len(passes) < 150, len(passes)


def test_minres():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 3))
    b[:, 1] = 0
    x = whitening.minres(lambda v: a @ v, b, steps=40, tolerance=1e-14)
    assert np.allclose(a @ x, b, atol=1e-8)


def rows_of(seed, n, d):
    rng = random.Random(seed)
    mixed = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    rows = []
    for i in range(n):
        f = [rng.gauss(0, 1) * 0.9**k for k in range(d)]
        rows.append((i, [float(np.float32(sum(a * b for a, b in zip(f, m)))) for m in mixed]))
    return rows


def check(made, kept, d):
    n = len(kept)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], object)
    sums = x.sum(axis=0)
    c = (x - np.array([s // n for s in sums], object)).astype(float) - np.array([s % n for s in sums], float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(32, d)
    z = c @ vectors[:, :k] / np.sqrt(values[:k])
    by = {(r.vec_id, r.component): r for r in made}
    assert len(made) == len(by) == n * k
    got = np.array([[by[i, j + 1].whitened for j in range(k)] for i, _ in kept])
    sign = np.sign((got * z).sum(axis=0))
    assert np.abs(got - z * sign).max() < 1e-6
    for (i, _), row in zip(kept, x):
        assert by[i, 1].deviation == sum((n * v - s) ** 2 for v, s in zip(row, sums)) and by[i, 1].n == n
    assert all(abs(by[kept[0][0], j + 1].explained - values[j] / values.sum()) < 1e-10 for j in range(k))
    assert len({r.identity_error for r in made}) == 1 and made[0].identity_error < 1e-9


@pytest.mark.parametrize("d", (5, 40))
def test_same_as_full_decomposition(spark, d):
    kept = rows_of(d, 300, d)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1001, [None] * d), (1002, [nan] + [0.0] * (d - 1)), (1003, [inf] + [0.0] * (d - 1)), (1004, []), (1005, [1.0] * (d + 1))]
    df = spark.createDataFrame([(i, v, 3, "a") for i, v in kept + odd], "vec_id long, embedding array<float>, n int, x string").repartition(5)
    check(whitening.whiten(df).collect(), kept, d)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0]), (7, [3.0, 6.5]), (7, [3.0, 6.5]), (None, [5.0, 12.0])], "vec_id long, embedding array<float>")
    made = whitening.whiten(df).collect()
    assert len(made) == 8 and {r.component for r in made} == {1, 2}
    wide = [(i, [1e15 * (i % 7), 1e9 * i, 3.0]) for i in range(40)]
    made = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in made} == {None} and made[0].identity_error < 1e-4


def test_exact_deviations():
    rng = np.random.default_rng(1)
    for reach in (100, 1 << 20, 1 << 40):
        x = rng.integers(-reach, reach, (50, 4))
        sums = [int(s) for s in x.sum(axis=0)]
        want = [sum((50 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
        assert whitening.deviations(x, 50, sums) == [w if w < 1 << 63 else None for w in want]
