"""A trained set of models, kept as parquet tables of parameters: no pickles.

Tables below a folder: ``scaler``, ``iforest`` (nodes), ``ocsvm`` (vectors),
``autoencoder`` (weights), ``history`` and ``meta``. Any model may be absent.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.ml import autoencoder, iforest, ocsvm, scaler
from tidewatch.schema import FEATURES
from tidewatch.sources.alerts import exists

PARTS = ("scaler", "iforest", "ocsvm", "autoencoder", "history", "meta")
log = logging.getLogger(__name__)


@dataclass
class Bundle:
    scaler: scaler.Scaler | None = None
    iforest: iforest.Forest | None = None
    ocsvm: ocsvm.OneClass | None = None
    autoencoder: autoencoder.Autoencoder | None = None

    @property
    def ready(self) -> bool:
        """A scaler and at least one model."""
        return self.scaler is not None and any(m is not None for m in (self.iforest, self.ocsvm, self.autoencoder))


def fit(data: DataFrame, config: Config = Config(), seed: int = 42, trees: int = 200, epochs: int = 200) -> Bundle:
    """All models from feature rows: one aggregate, one grouped job for the trees, two bounded samples."""
    s = scaler.fit(data)
    scaled = scaler.transform(data, s).select("scaled").persist()
    try:
        d = config.detection
        return Bundle(s, iforest.fit(scaled, trees=trees, seed=seed, contamination=d.contamination), ocsvm.fit(scaled, nu=d.contamination, seed=seed), autoencoder.fit(scaled, latent=d.ae_latent_dim, sigma=d.ae_threshold_sigma, seed=seed, epochs=epochs))
    finally:
        scaled.unpersist()


def save(spark: SparkSession, bundle: Bundle, folder: str) -> None:
    def put(rows: list[tuple], schema: str, name: str) -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")

    meta: list[tuple[str, float]] = []
    if bundle.scaler:
        put([(i, c, float(m), float(s)) for i, (c, m, s) in enumerate(zip(FEATURES, bundle.scaler.mean, bundle.scaler.scale, strict=True))], "i int, feature string, mean double, scale double", "scaler")
    if bundle.iforest:
        spark.createDataFrame(bundle.iforest.nodes, iforest.NODES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/iforest")
        meta += [("iforest.sample", float(bundle.iforest.sample)), ("iforest.offset", bundle.iforest.offset)]
    if bundle.ocsvm:
        put([(i, float(a), [float(x) for x in v]) for i, (a, v) in enumerate(zip(bundle.ocsvm.alpha, bundle.ocsvm.vectors, strict=True))], "i int, alpha double, vector array<double>", "ocsvm")
        meta += [("ocsvm.rho", bundle.ocsvm.rho), ("ocsvm.gamma", bundle.ocsvm.gamma)]
    if bundle.autoencoder:
        put([(k, list(w.shape), [float(x) for x in w.ravel()]) for k, w in bundle.autoencoder.weights.items()], "name string, shape array<int>, data array<double>", "autoencoder")
        put([tuple(map(float, h)) for h in bundle.autoencoder.history] or [], "epoch double, loss double, val_loss double, rate double", "history")
        meta.append(("autoencoder.threshold", bundle.autoencoder.threshold))
    put(meta, "name string, value double", "meta")


def load(spark: SparkSession, folder: str) -> Bundle:
    """What the folder has; each missing part is logged and left out."""

    def rows(name: str):
        if not exists(spark, f"{folder}/{name}"):
            log.warning("no %s in %s", name, folder)
            return None
        return spark.read.parquet(f"{folder}/{name}").collect()  # parameter tables are bounded

    meta = {r["name"]: r["value"] for r in rows("meta") or []}
    out = Bundle()
    if found := rows("scaler"):
        found.sort(key=lambda r: r["i"])
        out.scaler = scaler.Scaler(np.array([r["mean"] for r in found]), np.array([r["scale"] for r in found]))
    if exists(spark, f"{folder}/iforest"):
        out.iforest = iforest.Forest(spark.read.parquet(f"{folder}/iforest").toPandas(), int(meta["iforest.sample"]), meta["iforest.offset"])
    if found := rows("ocsvm"):
        found.sort(key=lambda r: r["i"])
        out.ocsvm = ocsvm.OneClass(np.array([r["vector"] for r in found]), np.array([r["alpha"] for r in found]), meta["ocsvm.rho"], meta["ocsvm.gamma"])
    if found := rows("autoencoder"):
        out.autoencoder = autoencoder.Autoencoder({r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in found}, meta.get("autoencoder.threshold", 0.05))
    return out


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Each expected part: whether it is there, and its bytes."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in PARTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = path.getFileSystem(conf)
        there = fs.exists(path)
        out.append((name, bool(there), int(fs.getContentSummary(path).getLength()) if there else 0))
    return spark.createDataFrame(out, "part string, present boolean, bytes bigint")


def score(data: DataFrame, bundle: Bundle) -> DataFrame:
    """``data`` with a nullable struct for each model; a row whose vector fails is null in all."""
    from tidewatch.functions.scalar import even

    out = scaler.transform(data, bundle.scaler)
    kinds = {"isolation_forest": "struct<anomaly:boolean,score:double>", "one_class_svm": "struct<anomaly:boolean,score:double>", "autoencoder": "struct<anomaly:boolean,mse:double,threshold:double>"}
    for name, model, module in (("isolation_forest", bundle.iforest, iforest), ("one_class_svm", bundle.ocsvm, ocsvm)):
        if model is None:
            out = out.withColumn(name, F.lit(None).cast(kinds[name]))
        else:
            out = module.score(out, model, name="__s")
            out = out.withColumn(name, F.struct((F.col("__s") < 0).alias("anomaly"), even(F.col("__s"), 4).alias("score"))).drop("__s")
    if bundle.autoencoder is None:
        out = out.withColumn("autoencoder", F.lit(None).cast(kinds["autoencoder"]))
    else:
        limit = float(bundle.autoencoder.threshold)
        out = autoencoder.score(out, bundle.autoencoder, name="__s")
        out = out.withColumn("autoencoder", F.struct((F.col("__s") > limit).alias("anomaly"), even(F.col("__s"), 6).alias("mse"), F.lit(round(limit, 6)).alias("threshold"))).drop("__s")
    return out.drop("scaled")
