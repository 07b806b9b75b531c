"""A penalised spline of the log odds: cubic B-splines, a penalty on second differences, optionally rising.

The fit minimises the negative log-likelihood plus half of ``penalty`` times the squared second
differences of the coefficients. Every Newton step needs the sums of the basis and of its
products, weighted, over the distinct scores: one aggregate of fixed size, whatever the rows. With ``rising``
no coefficient is below the one before, which makes the curve monotone; the steps then solve
a small problem with non-negative increments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DEGREE = 3
RIDGE = 1e-9  # keeps directions without data at zero


@dataclass(frozen=True)
class Spline:
    lo: float
    hi: float
    coefficients: tuple[float, ...]

    def __call__(self, score: Column) -> Column:
        """The curve; scores outside the fitted range count as its ends.

        Between two knots it is one cubic in the way from the first to the second.
        """
        k = len(self.coefficients)
        step = (self.hi - self.lo) / (k - DEGREE) or 1.0
        at = (F.least(F.greatest(score, F.lit(self.lo)), F.lit(self.hi)) - self.lo) / step
        piece = F.least(F.floor(at), F.lit(k - DEGREE - 1)).cast("int")
        cubic = []
        for i in range(k - DEGREE):
            a, b, c, d = self.coefficients[i : i + 4]
            cubic.append(((a + 4 * b + c) / 6, (c - a) / 2, (a - 2 * b + c) / 2, (d - a + 3 * (b - c)) / 6))
        # the four numbers of the piece, then Horner's rule
        chosen = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in cubic]), piece + 1)
        odds = F.aggregate(F.reverse(chosen), F.lit(0.0), lambda done, x: done * (at - piece) + x)
        return 1.0 / (1.0 + F.exp(-odds))


def roughness(n: int) -> np.ndarray:
    d = np.diff(np.eye(n), 2, axis=0)
    return d.T @ d


def rising_minimum(h: np.ndarray, b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """The x that minimises x'hx / 2 - b'x with all entries but the first not negative (active set)."""
    n = len(b)
    free = np.zeros(n, dtype=bool)
    free[0] = True
    x = np.zeros(n)
    x[0] = b[0] / h[0, 0]
    for _ in range(20 * n):
        gain = np.where(free, -np.inf, b - h @ x)
        enter = int(gain.argmax())
        if gain[enter] <= tolerance * (1.0 + np.abs(b).max()):
            break
        free[enter] = True
        while True:
            at = np.flatnonzero(free)
            target = np.zeros(n)
            target[at] = np.linalg.solve(h[np.ix_(at, at)], b[at])
            bad = [i for i in at[1:] if target[i] <= 0]
            if not bad:
                x = target
                break
            # go towards the target until an entry reaches zero, and hold it there
            part = min(x[i] / (x[i] - target[i]) if x[i] > target[i] else 0.0 for i in bad)
            x = x + part * (target - x)
            for i in bad:
                if x[i] <= 1e-15:
                    free[i], x[i] = False, 0.0
    return x


def basis_of(score: np.ndarray, lo: float, hi: float, k: int) -> np.ndarray:
    """(scores, k): the values of the basis; only four of a row are not zero."""
    at = (np.clip(score, lo, hi) - lo) / ((hi - lo) / (k - DEGREE) or 1.0)
    first = np.minimum(at.astype(np.int64), k - DEGREE - 1)
    t = at - first
    parts = ((1 - t) ** 3, (3 * t - 6) * t * t + 4, ((-3 * t + 3) * t + 3) * t + 1, t**3)
    out = np.zeros((len(score), k))
    for i, values in enumerate(parts):
        out[np.arange(len(score)), first + i] = values / 6
    return out


def _sums(spline: Spline):
    k = len(spline.coefficients)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            score, n, pos = (batch.column(c).to_numpy().astype(np.float64) for c in ("score", "n", "pos"))
            x = basis_of(score, spline.lo, spline.hi, k)
            odds = x @ np.array(spline.coefficients)
            p = 1.0 / (1.0 + np.exp(-odds))
            total[0] += (n * np.logaddexp(0.0, odds) - pos * odds).sum()
            total[1 : 1 + k] += x.T @ (n * p - pos)
            total[1 + k :] += (x.T @ (x * (n * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["t"])

    return run


def sums(weights: DataFrame, spline: Spline) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood, its gradient and its second derivatives, from ``(score, n, pos)`` rows; a row of fixed size per task."""
    k = len(spline.coefficients)
    parts = weights.select("score", "n", "pos").mapInArrow(_sums(spline), "t array<double>")
    found = parts.select(F.posexplode("t").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    row = [x for _, x in sorted((r["i"], r["x"]) for r in found)]
    return row[0], np.array(row[1 : 1 + k]), np.array(row[1 + k :]).reshape(k, k)


def fit_spline(
    weights: DataFrame, n_splines: int = 10, penalty: float = 0.6, rising: bool = True, rounds: int = 60
) -> Spline:
    """Fit on distinct ``(score, n, pos)`` rows; without rows the curve is one half everywhere."""
    if n_splines <= DEGREE:
        raise ValueError(f"at least {DEGREE + 1} splines are needed")
    lo, hi, n, pos = weights.agg(F.min("score"), F.max("score"), F.sum("n"), F.sum("pos")).first()
    if lo is None:
        return Spline(0.0, 1.0, (0.0,) * n_splines)
    start = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    rough = penalty * roughness(n_splines) + RIDGE * np.eye(n_splines)
    spline = Spline(lo, hi, (start,) * n_splines)
    climb = np.tril(np.ones((n_splines, n_splines)))  # coefficients from the first and the increments
    before = np.inf
    shrunk = 0
    at = np.array(spline.coefficients)
    last = at
    for _ in range(rounds):
        loss, gradient, second = sums(weights, spline)
        total = loss + 0.5 * at @ rough @ at
        if total > before + 1e-12 * abs(before) and shrunk < 20:  # too long a step
            at, shrunk = (at + last) / 2, shrunk + 1
            spline = Spline(lo, hi, tuple(at))
            continue
        h = second + rough
        wanted = h @ at - gradient - rough @ at
        new = climb @ rising_minimum(climb.T @ h @ climb, climb.T @ wanted) if rising else np.linalg.solve(h, wanted)
        moved = np.abs(new - at).max()
        settled = before - total < 1e-11 * (1.0 + abs(total))
        last, at, before, shrunk = at, new, total, 0
        spline = Spline(lo, hi, tuple(float(x) for x in at))
        if moved < 1e-9 * (1.0 + np.abs(at).max()) or settled:
            break
    return spline
