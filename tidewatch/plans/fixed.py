"""A small bundle of models with hand-written parameters, and the SQL that states what it gives.

Scoring is deterministic given the parameters, so a fixed bundle lets DuckDB check the
scorers, the vote and the alerts, whatever a fit would find.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidewatch.ml import autoencoder, bundle, iforest, ocsvm, scaler
from tidewatch.plans import oracle
from tidewatch.schema import FEATURES

MEAN = dict(hour=12.0, is_night=0.5, is_weekend=0.25, nb_files_accessed=1.0, nb_sensitive_files=0.25, nb_failed_logins=0.5, nb_processes=0.75, bytes_sent=20000.0, new_ip=0.125, sensitive_path_access=0.25, z_score_files=0.0, z_score_logins=0.0, velocity=0.05, entropy_commands=0.5)
SCALE = dict(hour=6.0, is_night=0.5, is_weekend=0.5, nb_files_accessed=1.5, nb_sensitive_files=0.5, nb_failed_logins=1.0, nb_processes=1.25, bytes_sent=40000.0, new_ip=0.5, sensitive_path_access=0.5, z_score_files=1.0, z_score_logins=1.0, velocity=0.25, entropy_commands=0.75)
#: Trees as (feature, cut, at most, above); a number is a leaf's depth.
TREES = (
    ("nb_files_accessed", 0.6, ("bytes_sent", 0.4, 9.0, 4.5), 3.25),
    ("hour", -0.9, 4.5, ("entropy_commands", 0.2, 9.5, 5.0)),
    ("nb_failed_logins", 0.3, ("z_score_files", 0.75, 8.5, 3.0), ("velocity", 0.0, 6.0, 2.5)),
)
SAMPLE, OFFSET = 256, -0.62
#: Weights and the coordinates that aren't 0 of the support vectors.
VECTORS = ((0.5, {"hour": -1.0, "nb_files_accessed": -0.5}), (1.0, {"is_night": -1.0, "bytes_sent": -0.5, "entropy_commands": -0.5}), (0.75, {"hour": 1.0, "is_night": 1.0, "nb_processes": 0.25}))
RHO, GAMMA = 0.55, 0.08
#: Features that the autoencoder gives back, as they are or cut off below 0; the others become 0.
PASSED, CUT_OFF = ("nb_files_accessed", "nb_processes"), ("nb_failed_logins", "entropy_commands")
LIFT, LIMIT = 50.0, 0.85


def nodes() -> pd.DataFrame:
    out = []
    for t, tree in enumerate(TREES):
        todo, free = [(0, tree)], 1
        while todo:
            at, part = todo.pop()
            if isinstance(part, tuple):
                feature, cut, low, high = part
                out.append((t, at, FEATURES.index(feature), cut, free, free + 1, 0.0))
                todo += [(free, low), (free + 1, high)]
                free += 2
            else:
                out.append((t, at, -1, 0.0, -1, -1, part))
    return pd.DataFrame(out, columns=iforest.COLUMNS)


def network() -> autoencoder.Autoencoder:
    """Weights that carry four features through all layers: one unit each, lifted above 0 where nothing is to be cut off."""
    model = autoencoder.Autoencoder.fresh(len(FEATURES), 4, np.random.default_rng(0))
    w = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for name, _, _, norm, _ in autoencoder.LAYERS:
        for unit, feature in enumerate((*PASSED, *CUT_OFF)):
            i = FEATURES.index(feature)
            if name == "enc_1":
                w["enc_1.kernel"][i, unit] = 1.0
                w["enc_1.bias"][unit] = LIFT if feature in PASSED else 0.0
            elif name == "output":
                w["output.kernel"][unit, i] = 1.0
                w["output.bias"][i] = -LIFT if feature in PASSED else 0.0
            else:
                w[f"{name}.kernel"][unit, unit] = 1.0
        if norm:  # (x - 1) / 0.5 * 0.5 + 1
            w |= {f"{name}.mean": w[f"{name}.mean"] + 1.0, f"{name}.var": w[f"{name}.var"] + 0.25 - autoencoder.EPSILON, f"{name}.gamma": w[f"{name}.gamma"] + 0.5, f"{name}.beta": w[f"{name}.beta"] + 1.0}
    return autoencoder.Autoencoder(w, LIMIT)


def models() -> bundle.Bundle:
    vectors = np.array([[v.get(c, 0.0) for c in FEATURES] for _, v in VECTORS])
    return bundle.Bundle(
        scaler.Scaler(np.array([MEAN[c] for c in FEATURES]), np.array([SCALE[c] for c in FEATURES])),
        iforest.Forest(nodes(), SAMPLE, OFFSET),
        ocsvm.OneClass(vectors, np.array([a for a, _ in VECTORS]), RHO, GAMMA),
        network(),
    )


def tree_sql(part) -> str:
    if not isinstance(part, tuple):
        return f"{part!r}::DOUBLE"
    feature, cut, low, high = part
    return f"CASE WHEN x_{feature} <= {cut!r}::DOUBLE THEN {tree_sql(low)} ELSE {tree_sql(high)} END"


def scores_sql(source: str = "g") -> str:
    """Tables s (scores) and m (anomalies, votes) over the feature rows of table ``source``."""
    scaled = ", ".join(f"CAST(CAST((CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE) - {MEAN[c]!r}::DOUBLE) / {SCALE[c]!r}::DOUBLE AS FLOAT) AS DOUBLE) AS x_{c}" for c in FEATURES)
    depth = " + ".join(f"({tree_sql(t)})" for t in TREES)
    path = f"{float(iforest.average_path(SAMPLE))!r}::DOUBLE"
    kernel = " + ".join(f"{a!r}::DOUBLE * exp(-{GAMMA!r}::DOUBLE * ({' + '.join(f'power(x_{c} - ({v.get(c, 0.0)!r}::DOUBLE), 2)' for c in FEATURES)}))" for a, v in VECTORS)
    lost = " + ".join([f"power(x_{c}, 2)" for c in FEATURES if c not in PASSED + CUT_OFF] + [f"power(x_{c} - greatest(x_{c}, 0::DOUBLE), 2)" for c in CUT_OFF])
    return f""",
x AS (SELECT *, {scaled} FROM {source}),
s AS (SELECT *, -power(2::DOUBLE, -({depth}) / {len(TREES)} / {path}) AS raw, {kernel} - {RHO!r}::DOUBLE AS svm, ({lost}) / {len(FEATURES)}::DOUBLE AS mse FROM x),
m AS (SELECT *, raw - ({OFFSET!r}::DOUBLE) AS forest, raw - ({OFFSET!r}::DOUBLE) < 0 AS a, svm < 0 AS b, mse > {LIMIT!r}::DOUBLE AS c FROM s),
v AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS votes FROM m)"""


def scored(minutes: int) -> str:
    return oracle.scored(minutes) + scores_sql()
