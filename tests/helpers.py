"""Raw events and rows for tests."""

from datetime import datetime, timedelta

from tidewatch.functions.scalar import as_instant
from tidewatch.schema import RAW_EVENT

START = datetime(2024, 1, 15, 10, 0)
BLANK = dict(username="u1", event_id="4624", rule_id="", agent_name="", src_ip="192.168.1.1", file_path="", process_name="", command_line="", bytes_sent=0, dst_ip="")


def raw(spark, events):
    """Events given as (minutes after START, changes)."""
    rows = []
    for k, (minutes, change) in enumerate(events):
        at = START + timedelta(minutes=minutes)
        row = BLANK | change
        rows.append((k, at, at.isoformat() + "+00:00", *[row[c] for c in list(BLANK)]))
    df = spark.createDataFrame(rows, "_seq bigint, ts_local timestamp_ntz, ts_text string, username string, event_id string, rule_id string, agent_name string, src_ip string, file_path string, process_name string, command_line string, bytes_sent bigint, dst_ip string")
    return df.withColumn("ts_utc", as_instant(df["ts_local"])).select(*RAW_EVENT.fieldNames())
