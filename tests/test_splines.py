"""Penalised splines: the small constrained problem, the basis, and the whole fit against plain Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibrate, splines


def basis(s, lo, hi, k):
    u = (np.clip(s, lo, hi) - lo) / ((hi - lo) / (k - 3))

    def b(x):
        t = np.array([max(0.0, x - i) ** 3 for i in range(5)])
        return t @ [1, -4, 6, -4, 1] / 6

    return np.array([[b(x - (j - 3)) for j in range(k)] for x in u])


def rows_of(spark, kind):
    rng = np.random.default_rng(7)
    s = np.round(rng.random(1500), 3)
    p = {"rising": s**2, "wave": 0.5 + 0.4 * np.sin(8 * s), "falling": 0.9 - 0.8 * s, "constant": 0 * s + 1}[kind]
    y = (rng.random(1500) < p).astype(int)
    return s, y, spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "s double, y int")


def test_rising_minimum_against_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a = rng.normal(size=(12, 5))
        h, b = a.T @ a + 1e-3 * np.eye(5), rng.normal(size=5) * 4
        best = np.inf
        for mask in range(16):
            at = [0, *[i + 1 for i in range(4) if mask >> i & 1]]
            x = np.zeros(5)
            x[at] = np.linalg.solve(h[np.ix_(at, at)], b[at])
            if (x[1:] >= 0).all():
                best = min(best, 0.5 * x @ h @ x - b @ x)
        got = splines.rising_minimum(h, b)
        assert (got[1:] >= 0).all() and 0.5 * got @ h @ got - b @ got == pytest.approx(best, abs=1e-8)


@pytest.mark.parametrize("kind", ["rising", "wave", "falling", "constant"])
@pytest.mark.parametrize("rising", [True, False])
def test_fit_is_the_penalised_optimum(spark, kind, rising):
    s, y, df = rows_of(spark, kind)
    fit = splines.fit_spline(calibrate.score_weights(df, "s", "y"), 8, 0.6, rising)
    c = np.array(fit.coefficients)
    x = basis(s, s.min(), s.max(), 8)
    assert np.allclose(x.sum(axis=1), 1)
    p = 1 / (1 + np.exp(-x @ c))
    slope = x.T @ (p - y) + 0.6 * splines.roughness(8) @ c
    if rising:
        steps, total = np.diff(c), np.cumsum(slope[::-1])[::-1]
        assert (steps >= 0).all() and abs(total[0]) < 1e-3
        assert all(abs(g) < 1e-3 if d > 1e-9 else g > -1e-3 for d, g in zip(steps, total[1:], strict=True))
    else:
        assert np.abs(slope).max() < 1e-3
    got = df.select(fit(F.col("s"))).toPandas().iloc[:, 0].to_numpy()
    assert np.allclose(got, p, atol=1e-9)


def test_spline_of_one_score_and_of_none(spark):
    one = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1)], "s double, y int")
    out = calibrate.gam_fit(one, "s", "y").apply(one, "s", "c").first()["c"]
    assert out == pytest.approx(2 / 3, abs=1e-3)
    none = calibrate.gam_fit(one.limit(0), "s", "y").apply(one, "s", "c").first()["c"]
    assert none == 0.5
