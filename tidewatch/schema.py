"""Schemas of events, features, predictions and alerts, and the event vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

#: Event ids by class, as the log sources number them, compared as text. Registry and DNS events only extend a session.
CLASSES = {
    "login_success": ("4624",),
    "login_failed": ("4625",),
    "logout": ("4634",),
    "process": ("4688", "1"),
    "file_access": ("4663", "11"),
    "registry": ("13",),
    "network": ("3",),
    "dns": ("22",),
}

RAW_EVENT = T.StructType([
    T.StructField("_seq", T.LongType()),
    T.StructField("ts_utc", T.TimestampType()),
    T.StructField("ts_local", T.TimestampNTZType()),
    T.StructField("ts_text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("username", "event_id", "rule_id", "agent_name", "src_ip", "file_path", "process_name", "command_line")],
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("dst_ip", T.StringType()),
])

#: Columns of the exported data set, in the order that readers of the file expect.
DATASET = (
    "timestamp", "username", "hour", "is_night", "is_weekend", "nb_files_accessed", "nb_sensitive_files", "nb_failed_logins", "nb_processes", "bytes_sent",
    "new_ip", "sensitive_path_access", "process_name", "command_line", "z_score_files", "z_score_logins", "velocity", "entropy_commands", "session_duration_min",
)

DATASET_SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c in ("timestamp", "username", "process_name", "command_line") else T.IntegerType() if c in ("hour", "is_night", "is_weekend", "new_ip", "sensitive_path_access") else T.DoubleType() if c.startswith("z_") or c in ("velocity", "entropy_commands", "session_duration_min") else T.LongType())
    for c in DATASET
])

#: Columns of the model's input vector, in the order that trained parameters refer to.
FEATURES = (
    "hour", "is_night", "is_weekend", "nb_files_accessed", "nb_sensitive_files", "nb_failed_logins", "nb_processes", "bytes_sent", "new_ip", "sensitive_path_access",
    "z_score_files", "z_score_logins", "velocity", "entropy_commands",
)

PREDICTION = T.StructType([
    T.StructField("isolation_forest", T.StructType([T.StructField("anomaly", T.BooleanType()), T.StructField("score", T.DoubleType())])),
    T.StructField("one_class_svm", T.StructType([T.StructField("anomaly", T.BooleanType()), T.StructField("score", T.DoubleType())])),
    T.StructField("autoencoder", T.StructType([T.StructField("anomaly", T.BooleanType()), T.StructField("mse", T.DoubleType()), T.StructField("threshold", T.DoubleType())])),
    T.StructField("votes", T.IntegerType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
])
