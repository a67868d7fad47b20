"""Votes, verdicts, severity and the shape of alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import even

#: Fixed value: the type that readers of the alerts look for.
TYPE = "ueba_anomaly"
MODELS = ("isolation_forest", "one_class_svm", "autoencoder")


def votes(*anomalies: Column) -> Column:
    """How many are true; null (no such model) counts as no vote."""
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(False)).cast("int") for x in anomalies])


def verdict(scored: DataFrame, threshold: int = 2, of_all: bool = False) -> DataFrame:
    """``scored`` with votes, is_anomaly and confidence from its nullable model structs.

    Confidence is the share of the models that are there, to 2 digits; with ``of_all``
    the share of all three, unrounded. The threshold is absolute.
    """
    flags = [F.col(m)["anomaly"] if m in scored.columns else F.lit(None).cast("boolean") for m in MODELS]
    there = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in flags])
    out = scored.withColumn("votes", votes(*flags))
    share = F.col("votes") / F.lit(3.0) if of_all else F.when(there > 0, even(F.col("votes") / there, 2)).otherwise(F.lit(0.0))
    return out.withColumn("is_anomaly", (there > 0) & (F.col("votes") >= threshold)).withColumn("confidence", share)


def severity(n: Column = None) -> Column:
    """HIGH for 3 votes or for 2 at high risk, MEDIUM for 2, else LOW."""
    n = F.col("votes") if n is None else n
    risky = (F.coalesce("nb_sensitive_files", F.lit(0)) > 0) | (F.coalesce("nb_failed_logins", F.lit(0)) >= 5) | (F.coalesce("is_night", F.lit(0)) != 0)
    return F.when((n == 3) | ((n == 2) & risky), "HIGH").when(n == 2, "MEDIUM").otherwise("LOW")


def shaped(scored: DataFrame, now: Column | None = None) -> DataFrame:
    """Alerts of the anomalous rows of ``verdict``'s result, as nested rows ready for JSON."""
    stamp = F.concat(F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    kinds = {"isolation_forest": "struct<anomaly:boolean,score:double>", "one_class_svm": "struct<anomaly:boolean,score:double>", "autoencoder": "struct<anomaly:boolean,mse:double,threshold:double>"}
    models = [F.col(m).cast(k).alias(m) if m in scored.columns else F.lit(None).cast(k).alias(m) for m, k in kinds.items()]
    return scored.filter("is_anomaly").select(
        stamp.alias("timestamp"),
        F.lit(TYPE).alias("type"),
        severity().alias("severity"),
        F.coalesce("username", F.lit("unknown")).alias("username"),
        F.coalesce("timestamp", F.lit("")).alias("session_ts"),
        "confidence",
        "votes",
        F.struct(*models).alias("models"),
        F.struct(
            F.coalesce(F.col("is_night").cast("boolean"), F.lit(False)).alias("is_night"),
            F.coalesce(F.col("is_weekend").cast("boolean"), F.lit(False)).alias("is_weekend"),
            F.coalesce("nb_failed_logins", F.lit(0)).cast("long").alias("nb_failed_logins"),
            F.coalesce("nb_sensitive_files", F.lit(0)).cast("long").alias("nb_sensitive_files"),
            F.coalesce("process_name", F.lit("")).alias("process_name"),
            F.coalesce("bytes_sent", F.lit(0)).cast("long").alias("bytes_sent"),
        ).alias("indicators"),
    )


def write(alerts: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append alerts as JSON lines; a batch that is written again replaces its own folder, so replays add nothing."""
    if batch_id is None:
        alerts.write.mode("append").option("ignoreNullFields", False).json(path)
    else:
        alerts.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/batch={batch_id}")
