"""Training: a data set, or simulated sessions, to a saved bundle of models, with what the training showed."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Config, load
from tidewatch.functions import reporting
from tidewatch.functions.storage import written
from tidewatch.ml import bundle as bundles
from tidewatch.ml import ensemble
from tidewatch.operators import alerts, baseline, evaluate, explore
from tidewatch.sources import simulate, tables

log = logging.getLogger("tidewatch.train")


def data_set(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A data set as exported, with z-scores where it lacks them."""
    data = tables.read_csv(spark, path) if kind == "csv" else spark.read.parquet(path)
    missing = [c for c in tables.REQUIRED if c not in data.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return data if all(z in data.columns for z in baseline.Z) else baseline.user_zscores(data)


def history(spark: SparkSession, bundle: bundles.Bundle) -> DataFrame:
    """The autoencoder's training by epoch."""
    rows = [tuple(map(float, h)) for h in bundle.autoencoder.history] if bundle.autoencoder else []
    return spark.createDataFrame(rows, "epoch double, loss double, val_loss double, rate double").withColumn("epoch", F.col("epoch").cast("int"))


def ranges(predicted: DataFrame) -> DataFrame:
    """Mean, least and greatest score of each model."""
    flat = ensemble.flat(predicted)
    return explore.range_of(flat, "if_score", "svm_score", "ae_error")


def train(spark: SparkSession, data: DataFrame, folder: str, config: Config = Config(), **options) -> bundles.Bundle:
    """Fit on ``data`` and save below ``folder``."""
    data = written(data, "training")
    bundle = bundles.fit(data, config, **options)
    bundles.save(spark, bundle, folder)
    predicted = written(ensemble.predict(data, bundle, config.detection.ensemble_threshold), "training-votes")
    flags = predicted.select("is_anomaly", *[F.col(m)["anomaly"].alias(m) for m in alerts.MODELS])
    for r in explore.rates(flags, {c: c for c in flags.columns}).collect():
        log.info("anomalous in training by %s: %.4f", r["name"], r["rate"] or 0.0)
    for r in ranges(predicted).collect():
        log.info("%s: mean %.6f, from %.6f to %.6f", *r)
    last = bundle.autoencoder.history[-1]
    log.info("autoencoder: %d epochs, loss %.6f, validation loss %.6f, threshold %.6f", len(bundle.autoencoder.history), last[1], last[2], bundle.autoencoder.threshold)
    for r in bundles.inventory(spark, folder).collect():
        log.info("%s: %s", r["part"], f"{r['bytes']} bytes" if r["present"] else "absent")
    return bundle


def main(argv: list[str] | None = None) -> int:
    import argparse

    args = argparse.ArgumentParser(description="Train the models on a data set of sessions.")
    args.add_argument("--input", help="a data set; simulated sessions if not given")
    args.add_argument("--format", choices=("csv", "parquet"), default="csv")
    args.add_argument("--simulate", type=int, default=300, metavar="N")
    args.add_argument("--models")
    args.add_argument("--config")
    args.add_argument("--epochs", type=int, default=200)
    args.add_argument("--trees", type=int, default=200)
    args.add_argument("--evaluate", action="store_true", help="report on simulated attacks")
    reporting.arguments(args)
    given = args.parse_args(argv)
    config = load(given.config, aliases=reporting.aliases(given))
    reporting.set_up(config.logging.level, given.verbose, given.log_file)
    spark = SparkSession.builder.appName("tidewatch-train").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    data = data_set(spark, given.input, given.format) if given.input else baseline.user_zscores(simulate.normal(spark, given.simulate))
    if data.isEmpty():
        log.error("no sessions to train on")
        return 1
    bundle = train(spark, data, given.models or config.paths.models_dir, config, trees=given.trees, epochs=given.epochs)
    if given.evaluate:
        predicted = ensemble.predict(baseline.user_zscores(simulate.test_set(spark)), bundle, config.detection.ensemble_threshold)
        for r in evaluate.report(predicted).collect():
            log.info("%s: precision %.3f, recall %.3f, f1 %.3f of %d", r["class"], r["precision"], r["recall"], r["f1"], r["support"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
