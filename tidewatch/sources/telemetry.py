"""The ``events`` table as raw events: a fixed convention that the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import as_instant

#: event_type of the table to event id.
IDS = {"signup": "4624", "error": "4625", "click": "4663", "view": "4688", "purchase": "3"}


def raw_events(events: DataFrame) -> DataFrame:
    """Raw events of ``events(event_id, ts, user_id, event_type, value, props)``; unknown types have id ''."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.col("event_type")
    name = F.concat(F.lit("doc_"), k.cast("string"))
    ids = F.create_map(*[F.lit(x) for pair in IDS.items() for x in pair])
    return events.select(
        F.col("event_id").alias("_seq"),
        as_instant(F.col("ts")).alias("ts_utc"),
        F.col("ts").alias("ts_local"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts_text"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.coalesce(F.try_element_at(ids, kind), F.lit("")).alias("event_id"),
        F.lit("").alias("rule_id"),
        F.lit("").alias("agent_name"),
        F.concat(F.lit("10.0.0."), (k % 8).cast("string")).alias("src_ip"),
        F.when(kind == "click", F.concat(F.when(k < 20, F.lit("C:\\Sensitive\\")).otherwise(F.lit("C:\\Users\\")), name)).otherwise("").alias("file_path"),
        F.when(kind == "view", F.concat(F.lit("proc_"), (k % 5).cast("string"))).otherwise("").alias("process_name"),
        F.when(kind == "view", F.concat(F.lit("cmd_"), (k % 7).cast("string"))).otherwise("").alias("command_line"),
        F.when(kind == "purchase", F.floor(F.col("value") * 100)).otherwise(F.lit(0)).cast("long").alias("bytes_sent"),
        F.lit("").alias("dst_ip"),
    )
