"""Sessions with state across batches: a watermark closes a session that stays idle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.functions.scalar import even, event_is, seconds_between
from tidewatch.operators.sessions import ORDER, when_filled


def entropy(values: Column) -> Column:
    """Shannon entropy in bits of an array's values, by the runs of the sorted array."""
    n = F.size(values).cast("double")
    log = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    first = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc, v):
        same = acc["last"] == v
        return F.struct(v.alias("last"), F.when(same, acc["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + log(acc["run"])).alias("sum"))

    # -sum(c/n log2(c/n)) = log2(n) - sum(c log2 c) / n
    total = F.aggregate(F.array_sort(values), first, step, lambda acc: acc["sum"] + log(acc["run"]))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.log2(n) - total / n, F.lit(0.0)))


def sessions(events: DataFrame, config: Config = Config(), minutes: float | None = None, delay: str = "10 minutes") -> DataFrame:
    """Feature rows of closed sessions of a stream (or of a batch) of raw events.

    Late events of closed sessions are dropped. The state of an open session holds its
    login addresses and commands and partial sums.
    """
    gap = config.input.session_minutes if minutes is None else minutes
    hidden = F.contains(F.lower("file_path"), F.lit(config.behavior.sensitive_path.lower()))
    # a session window ends its gap after the last event, exclusive; the gap itself still belongs to it
    window = F.session_window("ts_utc", F.lit(f"{int(gap * 60_000_000) + 1} microseconds"))
    command = when_filled("command_line", "process")
    found = events.withWatermark("ts_utc", delay).groupBy("username", window.alias("window")).agg(
        F.min("ts_utc").alias("start_ts"),
        F.max("ts_utc").alias("last_ts"),
        F.count("*").alias("nb_events"),
        F.min(F.struct(*ORDER, "ts_local", "ts_text")).alias("start"),
        F.count_if(event_is("login_failed")).alias("nb_failed_logins"),
        F.count_if(when_filled("file_path", "file_access")).alias("nb_files_accessed"),
        F.count_if(when_filled("file_path", "file_access") & hidden).alias("nb_sensitive_files"),
        F.count_if(when_filled("process_name", "process")).alias("nb_processes"),
        F.coalesce(F.sum(F.when(event_is("network"), F.col("bytes_sent"))), F.lit(0)).alias("bytes_sent"),
        F.min(F.when(when_filled("src_ip", "login_success"), F.col("src_ip"))).alias("ip_min"),
        F.max(F.when(when_filled("src_ip", "login_success"), F.col("src_ip"))).alias("ip_max"),
        F.min(F.when(when_filled("process_name", "process"), F.struct(*ORDER, "process_name"))).alias("process"),
        F.min(F.when(command, F.struct(*ORDER, "command_line"))).alias("first_command"),
        F.collect_list(F.when(command, F.col("command_line"))).alias("commands"),
    )
    local = F.col("start.ts_local")
    work = config.behavior
    length = F.greatest(seconds_between(F.col("start_ts"), F.col("last_ts")) / 60, F.lit(1.0))
    return found.select(
        F.col("start.ts_text").alias("timestamp"),
        "username",
        F.hour(local).alias("hour"),
        ((F.hour(local) < work.work_hour_start) | (F.hour(local) >= work.work_hour_end)).cast("int").alias("is_night"),
        (F.weekday(local) >= 5).cast("int").alias("is_weekend"),
        "nb_files_accessed", "nb_sensitive_files", "nb_failed_logins", "nb_processes", "bytes_sent",
        F.coalesce(F.col("ip_min") != F.col("ip_max"), F.lit(False)).cast("int").alias("new_ip"),
        (F.col("nb_sensitive_files") > 0).cast("int").alias("sensitive_path_access"),
        F.coalesce("process.process_name", F.lit("")).alias("process_name"),
        F.coalesce("first_command.command_line", F.lit("")).alias("command_line"),
        even(F.col("nb_files_accessed") / length, 4).alias("velocity"),
        even(entropy(F.col("commands")), 4).alias("entropy_commands"),
        even(length, 2).alias("session_duration_min"),
        "start_ts", "last_ts", "nb_events",
    )
