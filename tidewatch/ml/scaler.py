"""Standardising by population deviation; a constant column keeps unit scale."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import FEATURES
from tidewatch.sources.tables import with_features


@dataclass(frozen=True)
class Scaler:
    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((np.asarray(x, np.float64) - self.mean) / self.scale).astype(np.float32)


def clean(c: str):
    """A feature as the model sees it: 0 for null and NaN, single precision."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float")


def statistics(data: DataFrame) -> DataFrame:
    """One row with mean and population deviation (``m_``, ``s_``) of each feature."""
    full = with_features(data)
    return full.agg(*[F.avg(clean(c).cast("double")).alias(f"m_{c}") for c in FEATURES], *[F.when(F.max(clean(c)) == F.min(clean(c)), 0.0).otherwise(F.stddev_pop(clean(c).cast("double"))).alias(f"s_{c}") for c in FEATURES])


def fit(data: DataFrame) -> Scaler:
    row = statistics(data).first()
    scale = np.array([row[f"s_{c}"] or 0.0 for c in FEATURES])
    return Scaler(np.array([row[f"m_{c}"] or 0.0 for c in FEATURES]), np.where(scale == 0, 1.0, scale))


def transform(data: DataFrame, scaler: Scaler, name: str = "scaled") -> DataFrame:
    """``data`` with the standardised vector, as column arithmetic."""
    full = with_features(data)
    parts = [((clean(c).cast("double") - F.lit(float(m))) / F.lit(float(s))).cast("float") for c, m, s in zip(FEATURES, scaler.mean, scaler.scale, strict=True)]
    return full.select(*data.columns, F.array(*parts).alias(name))


def check(data: DataFrame, digits: int = 4) -> DataFrame:
    """Mean and deviation of each feature before and after scaling: (feature, mean, deviation, scaled_mean, scaled_deviation)."""
    scaler = fit(data)
    full = with_features(data)
    before = [F.struct(F.lit(c).alias("feature"), clean(c).cast("double").alias("x"), ((clean(c).cast("double") - F.lit(float(m))) / F.lit(float(s))).alias("y")) for c, m, s in zip(FEATURES, scaler.mean, scaler.scale, strict=True)]
    r = lambda x: F.round(x, digits) + F.lit(0.0)
    rows = full.select(F.inline(F.array(*before)))
    return rows.groupBy("feature").agg(r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("deviation"), r(F.avg("y")).alias("scaled_mean"), r(F.stddev_pop("y")).alias("scaled_deviation"))
