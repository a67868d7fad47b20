"""The online detector: each micro-batch runs the batch plan and appends alerts.

A batch's alerts go from lines to events, sessions (within the batch), features,
rolling z-scores over the history of accepted sessions of all users, votes and alert
rows. The folder of a batch holds the newest accepted sessions as of its end, so a batch
reads one folder of bounded size, and a replayed batch replaces what it wrote before
and reads that of an earlier batch. Lines that give no event, and sessions without a
user or a time, are logged, kept in a folder of rejects and left out of the history.
"""

from __future__ import annotations

import logging
import signal
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.config import Config, load
from tidewatch.functions import reporting
from tidewatch.ml import bundle as bundles
from tidewatch.ml.ensemble import predict
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators.baseline import rolling_zscores
from tidewatch.operators.sessions import session_features
from tidewatch.sources import alerts as alert_source
from tidewatch.sources.tail import TailSource

log = logging.getLogger("tidewatch.detector")
HISTORY = "seq bigint, username string, nb_files_accessed bigint, nb_failed_logins bigint"
#: Batches whose history is kept; a replay needs the one before.
KEPT = 10


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that have a folder, ascending; there are about KEPT of them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there) or []
    return sorted(int(x.getPath().getName().partition("=")[2]) for x in found)


def recent(spark: SparkSession, folder: str, batch_id: int, size: int) -> DataFrame:
    """The last ``size`` accepted sessions before a batch."""
    before = [b for b in batches(spark, folder) if b < batch_id]
    if not before:
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).parquet(f"{folder}/batch={before[-1]}").orderBy(F.desc("seq")).limit(size)


def remember(history: DataFrame, new: DataFrame, folder: str, batch_id: int, size: int) -> None:
    """Write the newest ``size`` of both as the history after a batch; forget all but the last KEPT batches."""
    spark, names = history.sparkSession, [c.split()[0] for c in HISTORY.split(", ")]
    both = new.select(*names).unionByName(history.select(*names)).orderBy(F.desc("seq")).limit(size)
    both.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    for old in [b for b in batches(spark, folder) if b < batch_id][:-KEPT]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def judged(features: DataFrame, history: DataFrame, models: bundles.Bundle, config: Config) -> DataFrame:
    """Feature rows with ``seq``, rolling z-scores and verdicts; rows without a user or time are left out of all.

    New sessions follow the history in order of user and start. A micro-batch is small,
    so its sessions are numbered in one task.
    """
    size = config.daemon.history_size
    last = history.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    new = features.filter("username is not null and start_ts is not null").crossJoin(F.broadcast(last))  # one row beside each
    new = new.withColumn("seq", F.col("last") + F.row_number().over(Window.orderBy("username", "start_ts", "first_seq"))).drop("last")
    old = history.select("seq", "username", "nb_files_accessed", "nb_failed_logins", F.lit(False).alias("__new"))
    both = new.withColumn("__new", F.lit(True)).unionByName(old, allowMissingColumns=True)
    scored = rolling_zscores(both, size).filter("__new").drop("__new")
    return predict(scored, models, config.detection.ensemble_threshold)


def handle(models: bundles.Bundle, config: Config, history_dir: str, output: str, rejects_dir: str | None = None):
    """Function of a micro-batch of lines (_seq, value); rejects go below ``rejects_dir``, beside the history if not given."""
    rejects_dir = rejects_dir or f"{history_dir}-rejects"

    def run(lines: DataFrame, batch_id: int) -> None:
        spark, size = lines.sparkSession, config.daemon.history_size
        lines = lines.filter("trim(value) <> ''").persist()
        events = alert_source.raw_events(alert_source.parse(lines)).persist()
        history = recent(spark, history_dir, batch_id, size)
        found = session_features(events, config)
        result = judged(found, history, models, config).persist()
        try:
            alert_ops.write(alert_ops.shaped(result), output, batch_id)
            bad = alert_source.rejected(lines, events).unionByName(unusable(found))
            bad.write.mode("overwrite").json(f"{rejects_dir}/batch={batch_id}")
            remember(history, result, history_dir, batch_id, size)
            for r in spark.read.schema(alert_source.REJECTED).json(f"{rejects_dir}/batch={batch_id}").groupBy("reason").count().collect():
                log.warning("batch %d: %d rejected: %s", batch_id, r["count"], r["reason"])
            for r in result.filter("is_anomaly").select("username", "votes", "confidence").limit(20).collect() if log.isEnabledFor(logging.DEBUG) else ():
                log.debug("alert of %s: %d votes, confidence %.2f", *r)
            log.info("batch %d: %d sessions, %d alerts", batch_id, result.count(), result.filter("is_anomaly").count())
        finally:
            for x in (result, events, lines):
                x.unpersist()

    return run


def unusable(features: DataFrame) -> DataFrame:
    """Feature rows without a user or a time, as rejects."""
    bad = features.filter("username is null or start_ts is null")
    return bad.select(F.col("first_seq").alias("_seq"), F.to_json(F.struct(*[c for c in features.columns])).alias("value"), F.lit("session without a user or a time").alias("reason"))


def start(spark: SparkSession, config: Config, models: bundles.Bundle, checkpoint: str, position: str = "latest", once: bool = False) -> StreamingQuery:
    """Follow the alert file; ``once`` handles what is there and stops."""
    if not models.ready:
        raise ValueError("no scaler, or no model")
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("path", config.input.alerts_path).option("startingPosition", position).load()
    writer = lines.writeStream.foreachBatch(handle(models, config, f"{checkpoint}/history", config.paths.alert_output)).option("checkpointLocation", f"{checkpoint}/offsets")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.daemon.poll_seconds} seconds")
    return writer.start()


def main(argv: list[str] | None = None) -> int:
    import argparse

    args = argparse.ArgumentParser(description="Detect anomalous sessions in a growing alert file.")
    args.add_argument("--config")
    args.add_argument("--checkpoint", required=True)
    args.add_argument("--position", choices=("latest", "earliest"), default="latest")
    reporting.arguments(args)
    given = args.parse_args(argv)
    config = load(given.config, aliases=reporting.aliases(given))
    reporting.set_up(config.logging.level, given.verbose, given.log_file)
    spark = SparkSession.builder.appName("tidewatch-detect").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    models = bundles.load(spark, config.paths.models_dir)
    if not models.ready:
        log.error("models in %s are not ready", config.paths.models_dir)
        return 1
    query = start(spark, config, models, given.checkpoint, given.position)
    stop_on_signals(query)
    query.awaitTermination()
    log.info("stopped")
    return 0


def stop_on_signals(query: StreamingQuery, signals=(signal.SIGTERM, signal.SIGINT)) -> None:
    """Let the signals end the query after its present batch."""
    for s in signals:
        signal.signal(s, lambda *_: query.stop())


if __name__ == "__main__":
    sys.exit(main())
