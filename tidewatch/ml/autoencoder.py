"""Autoencoder in NumPy: dense layers, batch normalisation, dropout, Adam, early stopping.

14-64-32-16-4-16-32-64-14, ReLU inside, linear code and output, L2 on the hidden
kernels, batch norm after the first two encoding layers and the second decoding one,
dropout after the first encoding and the decoding norm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.ml.sample import least_hashed

MOST_ROWS = 20_000
#: (name, units; 0 for the latent size, -1 for the input size; ReLU, norm after, dropout after)
LAYERS = (("enc_1", 64, True, True, 0.2), ("enc_2", 32, True, True, 0.0), ("enc_3", 16, True, False, 0.0), ("latent", 0, False, False, 0.0), ("dec_1", 16, True, False, 0.0), ("dec_2", 32, True, True, 0.2), ("dec_3", 64, True, False, 0.0), ("output", -1, False, False, 0.0))
L2, MOMENTUM, EPSILON = 1e-4, 0.99, 1e-3


@dataclass
class Autoencoder:
    weights: dict[str, np.ndarray]
    threshold: float = 0.05
    history: list[tuple[int, float, float, float]] = field(default_factory=list)

    @classmethod
    def fresh(cls, inputs: int, latent: int, rng: np.random.Generator) -> Autoencoder:
        w, before = {}, inputs
        for name, units, _, norm, _ in LAYERS:
            units = latent if units == 0 else inputs if units < 0 else units
            bound = np.sqrt(6 / (before + units))
            w[f"{name}.kernel"] = rng.uniform(-bound, bound, (before, units))
            w[f"{name}.bias"] = np.zeros(units)
            if norm:
                w |= {f"{name}.gamma": np.ones(units), f"{name}.beta": np.zeros(units), f"{name}.mean": np.zeros(units), f"{name}.var": np.ones(units)}
            before = units
        return cls(w)

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None):
        """Output, and with ``rng`` (training) what the gradient needs; running statistics move in training."""
        w, tape = self.weights, []
        for name, _, relu, norm, drop in LAYERS:
            step = {"x": x}
            x = x @ w[f"{name}.kernel"] + w[f"{name}.bias"]
            if relu:
                step["on"] = x > 0
                x = np.where(step["on"], x, 0)
            if norm:
                if rng is None:
                    mean, var = w[f"{name}.mean"], w[f"{name}.var"]
                else:
                    mean, var = x.mean(axis=0), x.var(axis=0)
                    w[f"{name}.mean"] = MOMENTUM * w[f"{name}.mean"] + (1 - MOMENTUM) * mean
                    w[f"{name}.var"] = MOMENTUM * w[f"{name}.var"] + (1 - MOMENTUM) * var
                step["sd"] = np.sqrt(var + EPSILON)
                step["hat"] = (x - mean) / step["sd"]
                x = step["hat"] * w[f"{name}.gamma"] + w[f"{name}.beta"]
            if drop and rng is not None:
                step["mask"] = (rng.random(x.shape) >= drop) / (1 - drop)
                x = x * step["mask"]
            tape.append(step)
        return (x, tape) if rng is not None else x

    def gradients(self, x: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Of the mean squared error of a batch against itself, with L2."""
        out, tape = self.forward(x, rng)
        d = 2 * (out - x) / x.size
        g = {}
        for (name, _, relu, norm, _), step in zip(reversed(LAYERS), reversed(tape), strict=True):
            if "mask" in step:
                d = d * step["mask"]
            if norm:
                g[f"{name}.gamma"], g[f"{name}.beta"] = (d * step["hat"]).sum(axis=0), d.sum(axis=0)
                d = d * self.weights[f"{name}.gamma"]
                d = (d - d.mean(axis=0) - step["hat"] * (d * step["hat"]).mean(axis=0)) / step["sd"]
            if relu:
                d = d * step["on"]
            g[f"{name}.kernel"] = step["x"].T @ d + (2 * L2 * self.weights[f"{name}.kernel"] if relu else 0)
            g[f"{name}.bias"] = d.sum(axis=0)
            d = d @ self.weights[f"{name}.kernel"].T
        return g

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Mean squared error of each row's reconstruction."""
        x = np.asarray(x, np.float64)
        return ((x - self.forward(x)) ** 2).mean(axis=1)

    def penalty(self) -> float:
        return L2 * sum(float((self.weights[f"{n}.kernel"] ** 2).sum()) for n, _, relu, _, _ in LAYERS if relu)


def train(x: np.ndarray, latent: int = 4, epochs: int = 200, batch: int = 32, rate: float = 1e-3, patience: int = 20, halve_after: int = 10, least_rate: float = 1e-6, seed: int = 42) -> Autoencoder:
    """Trained on the first four fifths of the rows and stopped by the loss on the rest; the best weights are restored."""
    x = np.asarray(x, np.float64)
    rng = np.random.default_rng(seed)
    cut = max(1, int(0.8 * len(x)))
    use, check = x[:cut], x[cut:] if cut < len(x) else x
    model = Autoencoder.fresh(x.shape[1], latent, rng)
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(u) for k, u in model.weights.items()}
    best, kept, wait, flat, t = np.inf, {k: u.copy() for k, u in model.weights.items()}, 0, 0, 0
    for epoch in range(epochs):
        order = rng.permutation(len(use))
        for lo in range(0, len(use), batch):
            part = use[order[lo : lo + batch]]
            t += 1
            for k, g in model.gradients(part, rng).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
        loss = float(model.errors(check).mean()) + model.penalty()
        model.history.append((epoch, float(model.errors(use).mean()) + model.penalty(), loss, rate))
        if loss < best - 1e-12:
            best, kept, wait, flat = loss, {k: u.copy() for k, u in model.weights.items()}, 0, 0
        else:
            wait, flat = wait + 1, flat + 1
            if wait >= patience:
                break
            if flat >= halve_after:
                rate, flat = max(rate / 2, least_rate), 0
    model.weights = kept
    return model


def fit(scaled: DataFrame, latent: int = 4, sigma: float = 3.0, most: int = MOST_ROWS, seed: int = 42, **options) -> Autoencoder:
    """Trained on at most ``most`` rows in a fixed random order; the threshold is mean + sigma * deviation of all rows' errors."""
    rows = least_hashed(scaled.select("scaled"), most, "scaled", seed=seed).toPandas()
    model = train(np.array(rows["scaled"].tolist(), np.float64), latent, seed=seed, **options)
    model.threshold = threshold(score(scaled, model), sigma)
    return model


def threshold(errors: DataFrame, sigma: float = 3.0, name: str = "mse") -> float:
    """Mean and ``sigma`` population deviations of the rows' errors."""
    e = errors.agg(F.avg(name), F.stddev_pop(name)).first()
    return float(e[0] + sigma * e[1])


def score(scaled: DataFrame, model: Autoencoder, name: str = "mse") -> DataFrame:
    shared = scaled.sparkSession.sparkContext.broadcast(model.weights)  # of fixed size

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(Autoencoder(shared.value).errors(np.array(v.tolist(), np.float64).reshape(len(v), -1)))

    return scaled.withColumn(name, run("scaled"))
