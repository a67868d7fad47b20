"""The vote of all models over feature rows, and one-row explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.ml.bundle import Bundle, score
from tidewatch.operators.alerts import MODELS, verdict

#: Scenarios of single sessions, in the order of schema.FEATURES with names: what a reader expects of the vote.
SCENARIOS = {
    "normal": dict(hour=10, is_night=0, is_weekend=0, nb_files_accessed=15, nb_sensitive_files=0, nb_failed_logins=0, nb_processes=8, bytes_sent=12000, new_ip=0, sensitive_path_access=0, z_score_files=0.2, z_score_logins=0.1, velocity=0.25, entropy_commands=0.8),
    "insider": dict(hour=2, is_night=1, is_weekend=1, nb_files_accessed=250, nb_sensitive_files=85, nb_failed_logins=2, nb_processes=18, bytes_sent=3500000, new_ip=1, sensitive_path_access=1, z_score_files=4.2, z_score_logins=0.5, velocity=12.5, entropy_commands=2.8),
    "malware": dict(hour=14, is_night=0, is_weekend=0, nb_files_accessed=45, nb_sensitive_files=3, nb_failed_logins=0, nb_processes=78, bytes_sent=850000, new_ip=1, sensitive_path_access=0, z_score_files=1.8, z_score_logins=0.0, velocity=8.2, entropy_commands=4.1),
    "brute_force": dict(hour=3, is_night=1, is_weekend=0, nb_files_accessed=2, nb_sensitive_files=1, nb_failed_logins=47, nb_processes=4, bytes_sent=5000, new_ip=1, sensitive_path_access=1, z_score_files=-0.8, z_score_logins=8.5, velocity=0.05, entropy_commands=1.2),
}


def predict(data: DataFrame, bundle: Bundle, threshold: int = 2, of_all: bool = False) -> DataFrame:
    """Models' structs, votes, is_anomaly and confidence beside the feature rows."""
    return verdict(score(data, bundle), threshold, of_all)


def flat(predicted: DataFrame) -> DataFrame:
    """Predictions with the models' signs (-1: anomalous) and scores as plain columns."""
    sign = lambda m: F.when(F.col(m)["anomaly"], -1).otherwise(1)
    return predicted.select("*", sign("isolation_forest").alias("if_pred"), F.col("isolation_forest.score").alias("if_score"), sign("one_class_svm").alias("svm_pred"), F.col("one_class_svm.score").alias("svm_score"), sign("autoencoder").alias("ae_pred"), F.col("autoencoder.mse").alias("ae_error")).drop(*MODELS)


def explain(spark: SparkSession, bundle: Bundle, session: dict, threshold: int = 2) -> dict:
    """The prediction of one session as a dict."""
    row = {k: float(v) if isinstance(v, (int, float)) else v for k, v in session.items()}
    got = predict(spark.createDataFrame([row]), bundle, threshold).first()
    return got.asDict(recursive=True)
