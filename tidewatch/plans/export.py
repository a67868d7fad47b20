"""Batch export: an alert file to the data set of session features, as CSV or Parquet."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from tidewatch.config import Config, load
from tidewatch.functions import reporting
from tidewatch.functions.storage import written
from tidewatch.operators import baseline, explore, sessions
from tidewatch.operators.sessions import session_features
from tidewatch.sources import alerts, tables

log = logging.getLogger("tidewatch.export")


def features(spark: SparkSession, path: str, config: Config = Config(), split: str | None = None) -> DataFrame:
    """Feature rows with z-scores of an alert file; ``split`` is a period, or auto to choose one where a user is very busy."""
    events = alerts.raw_events(alerts.load(spark, path))
    if split == "auto":
        events = written(events, "events")
        split = sessions.split_for(events)
    return baseline.user_zscores(session_features(events, config, split=split), skewed=split is not None)


def main(argv: list[str] | None = None) -> int:
    import argparse

    args = argparse.ArgumentParser(description="Export session features of an alert file.")
    args.add_argument("--input")
    args.add_argument("--output", required=True)
    args.add_argument("--config")
    args.add_argument("--session-min", type=float)
    args.add_argument("--format", choices=("csv", "parquet"), default="csv")
    args.add_argument("--split", default="auto", choices=("auto", "never", "month", "week", "day", "hour"), help="deal a user's events by period")
    args.add_argument("--single", action="store_true", help="gather the CSV into one file, for small data sets")
    reporting.arguments(args)
    given = args.parse_args(argv)
    config = load(given.config, aliases=reporting.aliases(given))
    if given.session_min is not None:
        import dataclasses

        config = dataclasses.replace(config, input=dataclasses.replace(config.input, session_minutes=given.session_min))
    reporting.set_up(config.logging.level, given.verbose, given.log_file)
    spark = SparkSession.builder.appName("tidewatch-export").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = features(spark, given.input or config.input.alerts_path, config, None if given.split == "never" else given.split).persist()
    total = explore.summary(found).first()
    if not total["sessions"]:
        log.error("no session found")
        return 1
    data = baseline.dataset(found)
    if given.format == "csv":
        tables.write_csv(data, given.output, single=given.single)
    else:
        data.write.mode("overwrite").parquet(given.output)
    log.info("%d sessions of %d users, %s to %s", total["sessions"], total["users"], total["first_ts"], total["last_ts"])
    for r in explore.users(found).limit(20).collect() if log.isEnabledFor(logging.DEBUG) else ():
        log.debug("%s: %d sessions, first %s", r["username"], r["sessions"], r["first_ts"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
