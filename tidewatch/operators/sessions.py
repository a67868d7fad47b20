"""Inactivity sessions and their behavioural features.

A session of a user ends where the next event is more than ``minutes`` later. Two
plans give the same sessions:

* ``sessions(events)``: one shuffle on the user. Gaps, running session numbers and
  both levels of aggregation use that one partitioning.
* ``sessions(events, split="day")``: for data in which one user holds a large part of
  all rows. Events are dealt by user and period, so a busy user is many tasks; a small
  table with one row for each user and period carries the last event and the last
  session start across periods, and sessions are aggregated with partial sums.

Commands are counted before their entropy is taken, so no session's events are ever
gathered in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.functions.scalar import even, event_is, seconds_between

ORDER = ("ts_utc", "_seq")


def numbered(events: DataFrame, minutes: float) -> DataFrame:
    """Events with ``session``: the place of their session among the user's."""
    by = Window.partitionBy("username").orderBy(*ORDER)
    gap = seconds_between(F.lag("ts_utc").over(by), F.col("ts_utc"))
    new = F.when(gap.isNull() | (gap > minutes * 60), 1).otherwise(0)
    return events.withColumn("__new", new).withColumn("session", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def started(events: DataFrame, minutes: float, split: str) -> DataFrame:
    """Events with ``session``: the microsecond at which their session starts; dealt by user and period."""
    events = events.withColumn("__part", F.date_trunc(split, "ts_utc"))
    by = Window.partitionBy("username", "__part").orderBy(*ORDER)
    at = F.unix_micros("ts_utc")
    part = events.groupBy("username", "__part").agg(F.max(at).alias("last"))
    over = Window.partitionBy("username").orderBy("__part")
    part = part.select("username", "__part", F.lag("last").over(over).alias("before"))
    joined = events.join(part, ["username", "__part"])
    previous = F.coalesce(F.lag(at).over(by), F.col("before"))
    fresh = F.when(previous.isNull() | (at - previous > int(minutes * 60_000_000)), at)
    marked = joined.withColumn("__fresh", fresh)
    carry = marked.groupBy("username", "__part").agg(F.max("__fresh").alias("fresh"))
    carry = carry.select("username", "__part", F.max("fresh").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    out = marked.join(carry, ["username", "__part"])
    own = F.max("__fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("session", F.coalesce(own, F.col("carried"))).drop("__fresh", "__part", "before", "carried")


#: Events of one user that a task can take well.
BUSY = 5_000_000


def split_for(events: DataFrame, busy: int = BUSY) -> str | None:
    """The period by which to deal events, by the busiest user's: None (one task a user) up to ``busy``, else the longest that parts them enough."""
    most = events.groupBy("username").agg(F.count("*").alias("n"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last")).orderBy(F.desc("n")).first()
    if most is None or most["n"] <= busy:
        return None
    days = max((most["last"] - most["first"]).total_seconds() / 86400, 1e-9)
    lengths = {"month": 30, "week": 7, "day": 1, "hour": 1 / 24}
    return next((p for p, length in lengths.items() if most["n"] * min(length / days, 1) <= busy), "hour")


def when_filled(column: str, *classes: str) -> Column:
    return event_is(*classes) & (F.col(column) != "")


def first_of(column: str, condition: Column) -> Column:
    """The value of the earliest event that meets a condition."""
    return F.min_by(F.when(condition, F.col(column)), F.when(condition, F.struct(*ORDER)))


def sessions(events: DataFrame, minutes: float = 60, sensitive: str = Config().behavior.sensitive_path, split: str | None = None) -> DataFrame:
    """One row per session: username, session, bounds, counts, first names and command entropy."""
    placed = started(events, minutes, split) if split else numbered(events, minutes)
    hidden = F.contains(F.lower("file_path"), F.lit(sensitive.lower()))
    command = when_filled("command_line", "process")
    login = event_is("login_success")
    # events of one command first: sums of these are sums over the session
    some = placed.groupBy("username", "session", F.when(command, F.col("command_line")).alias("command")).agg(
        F.count("*").alias("n"),
        F.min("ts_utc").alias("start_ts"),
        F.max("ts_utc").alias("last_ts"),
        F.min(F.struct(*ORDER, "ts_local", "ts_text")).alias("start"),
        F.count_if(login).alias("login_count"),
        F.count_if(event_is("logout")).alias("logout_count"),
        F.count_if(event_is("login_failed")).alias("nb_failed_logins"),
        F.count_if(when_filled("file_path", "file_access")).alias("nb_files_accessed"),
        F.count_if(when_filled("file_path", "file_access") & hidden).alias("nb_sensitive_files"),
        F.count_if(when_filled("process_name", "process")).alias("nb_processes"),
        F.sum(F.when(event_is("network"), F.col("bytes_sent"))).alias("bytes_sent"),
        F.min(F.when(when_filled("src_ip", "login_success"), F.col("src_ip"))).alias("ip_min"),
        F.max(F.when(when_filled("src_ip", "login_success"), F.col("src_ip"))).alias("ip_max"),
        F.min(F.when(when_filled("src_ip", "login_success"), F.struct(*ORDER, "src_ip"))).alias("ip"),
        F.min(F.when(when_filled("process_name", "process"), F.struct(*ORDER, "process_name"))).alias("process"),
        F.min(F.when(command, F.struct(*ORDER, "command_line"))).alias("first_command"),
    )
    used = F.when(F.col("command").isNotNull(), F.col("n"))
    total = F.sum(used)
    # -sum(c/n log2(c/n)) = log2(n) - sum(c log2 c) / n
    entropy = F.coalesce(F.log2(total) - F.sum(used * F.log2(used)) / total, F.lit(0.0))
    return some.groupBy("username", "session").agg(
        F.sum("n").alias("nb_events"),
        F.min("start_ts").alias("start_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min("start").alias("start"),
        *[F.sum(c).alias(c) for c in ("login_count", "logout_count", "nb_failed_logins", "nb_files_accessed", "nb_sensitive_files", "nb_processes")],
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent"),
        # more than one address exactly where the least and the greatest differ
        F.coalesce(F.min("ip_min") != F.max("ip_max"), F.lit(False)).cast("int").alias("new_ip"),
        F.coalesce(F.min("ip")["src_ip"], F.lit("")).alias("first_ip"),
        F.coalesce(F.min("process")["process_name"], F.lit("")).alias("process_name"),
        F.coalesce(F.min("first_command")["command_line"], F.lit("")).alias("command_line"),
        F.greatest(entropy, F.lit(0.0)).alias("entropy"),
    )


def features(found: DataFrame, config: Config = Config()) -> DataFrame:
    """Feature rows of ``sessions``: the exported columns but the z-scores, and the typed bounds."""
    local = F.col("start.ts_local")
    hour = F.hour(local)
    work = config.behavior
    minutes = F.greatest(seconds_between(F.col("start_ts"), F.col("last_ts")) / 60, F.lit(1.0))
    return found.select(
        F.col("start.ts_text").alias("timestamp"),
        "username",
        hour.alias("hour"),
        ((hour < work.work_hour_start) | (hour >= work.work_hour_end)).cast("int").alias("is_night"),
        (F.weekday(local) >= 5).cast("int").alias("is_weekend"),
        "nb_files_accessed",
        "nb_sensitive_files",
        "nb_failed_logins",
        "nb_processes",
        "bytes_sent",
        "new_ip",
        (F.col("nb_sensitive_files") > 0).cast("int").alias("sensitive_path_access"),
        "process_name",
        "command_line",
        even(F.col("nb_files_accessed") / minutes, 4).alias("velocity"),
        even(F.col("entropy"), 4).alias("entropy_commands"),
        even(minutes, 2).alias("session_duration_min"),
        "start_ts",
        "last_ts",
        F.col("start._seq").alias("first_seq"),
    )


def session_features(events: DataFrame, config: Config = Config(), minutes: float | None = None, split: str | None = None) -> DataFrame:
    return features(sessions(events, config.input.session_minutes if minutes is None else minutes, config.behavior.sensitive_path, split), config)
