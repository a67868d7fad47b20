"""Isolation forest: trees are grown in tasks from one bounded pool of rows, rows are scored in Arrow batches.

A tree isolates the points of its sample by random cuts; the mean depth at which a
row ends, over that expected of a random search tree, gives its score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.storage import written
from tidewatch.ml.sample import least_hashed
from tidewatch.operators import quantiles

NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"
COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, depth) of one tree; a leaf has feature -1 and its adjusted depth."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    free = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        varied = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else np.zeros(0, int)
        if depth >= limit or not len(varied):
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        f = int(rng.choice(varied))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        under = part[:, f] <= cut
        nodes.append((node, f, cut, free, free + 1, 0.0))
        todo += [(free, rows[under], depth + 1), (free + 1, rows[~under], depth + 1)]
        free += 2
    return nodes


@dataclass
class Forest:
    nodes: pd.DataFrame
    sample: int
    offset: float = -0.5

    def __post_init__(self):
        self.trees = [t.sort_values("node")[["feature", "threshold", "left", "right", "depth"]].to_numpy(np.float64) for _, t in self.nodes.groupby("tree")]

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2 ** (-mean depth / expected depth): near -1 for rows that are easily isolated."""
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                feature = tree[at, 0].astype(np.int64)
                inner = np.flatnonzero(feature >= 0)
                if not len(inner):
                    break
                low = x[inner, feature[inner]] <= tree[at[inner], 1]
                at[inner] = np.where(low, tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)
            total += tree[at, 4]
        return -np.power(2.0, -total / len(self.trees) / max(float(average_path(self.sample)), 1e-9))

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) - self.offset


#: Rows from which all trees draw, at most: as many as 200 trees of 256 rows take together.
POOL = 51_200


def fit(scaled: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42, contamination: float = 0.05, pool: int = POOL) -> Forest:
    """A forest from ``scaled(scaled array<float>)``; the offset is the contamination quantile of all training scores.

    One scan draws a pool of at most ``pool`` rows by a seeded hash; each tree takes
    ``sample`` of them without replacement. Trees grow one task each. The quantile is
    exact, over every row.
    """
    rows = least_hashed(scaled.select("scaled"), pool, "scaled", seed=seed).toPandas()
    x = np.array(rows["scaled"].tolist(), np.float32).reshape(len(rows), -1)
    size = min(sample, len(x))
    spark = scaled.sparkSession
    shared = spark.sparkContext.broadcast(x)  # pool rows at most

    def build(batches):
        for batch in batches:
            for t in batch["id"]:
                rng = np.random.default_rng((seed, int(t)))
                own = rng.choice(len(shared.value), size, replace=False) if size else np.zeros(0, int)
                out = pd.DataFrame(grow(shared.value[own].astype(np.float64), rng), columns=COLUMNS[1:])
                out.insert(0, "tree", np.int32(t))
                yield out

    forest = Forest(spark.range(0, trees, 1, min(trees, 32)).mapInPandas(build, NODES).toPandas(), size)
    scores = written(score(scaled, forest, raw=True).select("score"), "forest-scores")
    offset = quantiles.exact(scores, {"score": (contamination,)})["score", contamination]
    forest.offset = -0.5 if offset is None else float(offset)
    return forest


def score(scaled: DataFrame, forest: Forest, raw: bool = False, name: str = "score") -> DataFrame:
    """``scaled`` with its decision value (below 0: anomalous) or, if ``raw``, its score."""
    shared = scaled.sparkSession.sparkContext.broadcast(forest)  # trees * (2 * sample) nodes at most

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64).reshape(len(v), -1)
        f = shared.value
        return pd.Series(f.score(x) if raw else f.decision(x))

    return scaled.withColumn(name, run("scaled"))
