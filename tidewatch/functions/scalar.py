"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A numeric zone at the end of a time.
ZONE = r"(?<=:\d{2}|:\d{2}\.\d{1,9}|[T ]\d{2})[+-]\d{2}:?\d{2}(:?\d{2})?$"
#: The basic form, YYYYMMDDTHHMMSS, with an optional zone.
BASIC = r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(\d{2})(.*)$"


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def whole_number(text: Column) -> Column:
    """A text as a long, 0 where it isn't one; numbers with a fraction are 0 too."""
    plain = stripped(text)
    return F.coalesce(F.when(plain.rlike(r"^[+-]?\d+$"), plain).try_cast("long"), F.lit(0))


def with_times(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ts_text, ts_utc and ts_local of the ISO-8601 column ``text``; null where it isn't one.

    ts_text is the extended form with a numeric zone (UTC if it has none), ts_utc its
    instant, ts_local the date and time as written. Each step is a projection of its
    own, so that no pattern is matched more than once.
    """
    t = F.col("ts_text")
    steps = (
        F.regexp_replace(stripped(F.col(text)), BASIC, r"$1-$2-$3T$4:$5:$6$7"),
        F.regexp_replace(t, "[Zz]$", "+00:00"),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00"))).otherwise(t),
        F.when(t.rlike(ZONE), t).otherwise(F.concat(t, F.lit("+00:00"))),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}"), t),
    )
    for step in steps:
        df = df.withColumn("ts_text", step)
    return df.withColumns({"ts_utc": t.try_cast("timestamp"), "ts_local": F.regexp_replace(t, ZONE, "").try_cast("timestamp_ntz")})


def as_instant(local: Column) -> Column:
    """The instant at which a UTC clock shows a local time, whatever the session's zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, local))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def event_is(*classes: str) -> Column:
    from tidewatch.schema import CLASSES

    return F.col("event_id").isin(*[i for c in classes for i in CLASSES[c]])


def even(x: Column, digits: int) -> Column:
    """Rounded half to even, never -0.0."""
    return F.bround(x, digits) + F.lit(0.0)
