"""Alert files: NDJSON or one JSON array, read as text so that bad lines only cost themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalar
from tidewatch.schema import RAW_EVENT


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a glob pattern, names something that Spark can read."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(_seq, value)``: the non-blank lines of a file or folder; no rows if it is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "_seq bigint, value string")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_seq"), scalar.stripped(F.col("value")).alias("value"))
    return lines.filter("value <> ''")


def parse(lines: DataFrame) -> DataFrame:
    """``(_seq, alert)``: objects of valid JSON lines as variants; a line that holds an array gives its elements."""
    parsed = lines.select("_seq", F.try_parse_json("value").alias("v")).filter(F.col("v").isNotNull())
    one = parsed.filter(F.schema_of_variant("v").startswith("OBJECT")).select("_seq", F.col("v").alias("alert"))
    many = parsed.filter(F.schema_of_variant("v").startswith("ARRAY"))
    inner = many.selectExpr("_seq", "explode(try_variant_get(v, '$', 'array<variant>')) as alert")
    return one.unionByName(inner.filter(F.schema_of_variant("alert").startswith("OBJECT")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """``(_seq, alert)`` of a file: one JSON array over any number of lines, or else NDJSON."""
    if not exists(spark, path):
        return parse(read_lines(spark, path))
    first = spark.read.text(path).select(scalar.stripped(F.col("value")).alias("value")).filter("value <> ''").first()
    if first is not None and first["value"].startswith("["):
        whole = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("_seq"), "value")
        valid = whole.filter(F.try_parse_json("value").isNotNull())
        if not valid.isEmpty():
            return parse(valid)
    return parse(read_lines(spark, path))


REJECTED = "_seq bigint, value string, reason string"


def rejected(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Of ``lines(_seq, value)`` those that gave none of ``events``, with the reason."""
    bad = lines.select("_seq", "value").join(events.select("_seq").distinct(), "_seq", "left_anti")
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    reason = F.when(v.isNull(), "not JSON").when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), "neither an object nor an array").otherwise("no valid timestamp")
    return bad.select("_seq", "value", reason.alias("reason"))


def at(path: str):
    """A text at a path of the alert; null where it is absent, null or nested."""
    return F.try_variant_get("alert", f"$.{path}", "string")


def raw_events(alerts: DataFrame) -> DataFrame:
    """Flat events of alerts; those without a valid timestamp are dropped.

    Shape errors and nulls count as missing. Numbers read as their text. A timestamp
    without a zone is UTC.
    """
    event = "data.win.eventdata."
    user = scalar.first_filled(at(event + "subjectUserName"), at(event + "targetUserName"), at("data.srcuser"), at("predecoder.user"), F.lit("unknown"))
    flat = alerts.select(
        "_seq",
        scalar.first_filled(at("timestamp"), F.try_variant_get("alert", "$['@timestamp']", "string")).alias("__time"),
        F.lower(scalar.stripped(user)).alias("username"),
        scalar.stripped(scalar.first_filled(at("data.win.system.eventID"), at("data.id"))).alias("event_id"),
        scalar.first_filled(at("rule.id")).alias("rule_id"),
        scalar.first_filled(at("agent.name")).alias("agent_name"),
        scalar.first_filled(at("data.srcip"), at(event + "ipAddress")).alias("src_ip"),
        scalar.first_filled(at(event + "targetFilename"), at(event + "objectName")).alias("file_path"),
        scalar.first_filled(at(event + "image"), at(event + "parentImage"), at("data.process.name")).alias("process_name"),
        scalar.first_filled(at(event + "commandLine")).alias("command_line"),
        scalar.first_filled(at("data.bytes_sent")).alias("bytes_sent"),
        scalar.first_filled(at(event + "destinationIp")).alias("dst_ip"),
    )
    flat = scalar.with_times(flat.filter("__time <> ''"), "__time").filter("ts_utc is not null")
    return flat.withColumn("bytes_sent", scalar.whole_number(F.col("bytes_sent"))).select(*RAW_EVENT.fieldNames())
