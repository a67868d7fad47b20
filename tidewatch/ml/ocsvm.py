"""One-class support vector machine with an RBF kernel, fitted on a bounded sample by pairwise steps.

Minimises half of a'Ka with 0 <= a <= 1/(nu n) and sum(a) = 1, moving weight between the
pair of points that violates optimality the most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.ml.sample import least_hashed

MOST_ROWS = 2000


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


@dataclass
class OneClass:
    vectors: np.ndarray
    alpha: np.ndarray
    rho: float
    gamma: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        return kernel(np.asarray(x, np.float64), self.vectors, self.gamma) @ self.alpha - self.rho


def solve(x: np.ndarray, nu: float = 0.05, gamma: float | None = None, tolerance: float = 1e-4, steps: int = 200_000) -> OneClass:
    x = np.asarray(x, np.float64)
    n = len(x)
    spread = x.var()
    gamma = gamma or (1 / (x.shape[1] * spread) if spread > 0 else 1.0)
    k = kernel(x, x, gamma)
    # weights as counts of nu * n, at most 1 each
    top = 1.0
    a = np.zeros(n)
    whole = int(nu * n)
    a[:whole] = top
    if whole < n:
        a[whole] = nu * n - whole
    g = k @ a
    for _ in range(steps):
        up, down = a < top - 1e-12, a > 1e-12
        i = int(np.argmin(np.where(up, g, np.inf)))
        j = int(np.argmax(np.where(down, g, -np.inf)))
        if g[j] - g[i] < tolerance:
            break
        move = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), top - a[i], a[j])
        a[i] += move
        a[j] -= move
        g += move * (k[:, i] - k[:, j])
    free = (a > 1e-9) & (a < top - 1e-9)
    rho = g[free].mean() if free.any() else (g[a > 1e-9].max() + g[a <= 1e-9].min()) / 2 if (a <= 1e-9).any() else g.max()
    kept = a > 1e-9
    return OneClass(x[kept], a[kept], float(rho), float(gamma))


def fit(scaled: DataFrame, nu: float = 0.05, most: int = MOST_ROWS, seed: int = 42) -> OneClass:
    """Fitted on the ``most`` rows of least seeded hash (all rows, if fewer)."""
    rows = least_hashed(scaled.select("scaled"), most, "scaled", seed=seed).toPandas()
    return solve(np.array(rows["scaled"].tolist(), np.float64), nu)


def score(scaled: DataFrame, model: OneClass, name: str = "score") -> DataFrame:
    shared = scaled.sparkSession.sparkContext.broadcast(model)  # at most MOST_ROWS vectors

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.decision(np.array(v.tolist(), np.float64).reshape(len(v), -1)))

    return scaled.withColumn(name, run("scaled"))
