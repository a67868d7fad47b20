"""CSV data sets and model-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import DATASET_SCHEMA, FEATURES

#: Columns a data set must have to train on; z-scores are computed where they are absent.
REQUIRED = (*[c for c in FEATURES if not c.startswith("z_")], "timestamp", "username")


def write_csv(data: DataFrame, path: str, single: bool = False) -> None:
    """A CSV folder with headers, overwritten; ``single`` gathers it into one file, for small exports."""
    out = data.coalesce(1) if single else data
    out.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV data set: columns are matched by header, required ones checked, label 0 where absent, bad timestamps null."""
    names = spark.read.option("header", True).csv(path).columns
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = {f.name: f.dataType.simpleString() for f in DATASET_SCHEMA}
    reader = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\\N").schema(", ".join(f"`{n}` string" for n in names))
    rows = reader.csv(path)
    out = rows.select(*[F.col(f"`{n}`").try_cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in names])
    if "label" not in names:
        out = out.withColumn("label", F.lit(0))
    else:
        out = out.withColumn("label", F.coalesce(F.col("label").try_cast("int"), F.lit(0)))
    return out.withColumn("ts", F.col("timestamp").try_cast("timestamp"))


def with_features(data: DataFrame) -> DataFrame:
    """``data`` with each feature that it lacks as 0.0."""
    return data.withColumns({c: F.lit(0.0) for c in FEATURES if c not in data.columns})


def vector(data: DataFrame, name: str = "vector") -> DataFrame:
    """``data`` with the model's input: an array of floats, 0 for what is null, NaN or absent."""
    full = with_features(data)
    parts = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float") for c in FEATURES]
    return full.select(*data.columns, F.array(*parts).alias(name))
