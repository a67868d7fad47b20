"""Row numbers in a global order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.storage import written


def with_sequence(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """``df`` with 0-based row numbers in ``order``.

    Rows are range-partitioned, sorted and written once, so their places stay the same;
    the sizes of the partitions before, one row each, are added to places within one.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = written(placed, "sequence").withColumn("__part", F.shiftright("__at", 33))
    sizes = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n
    offsets = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__part bigint, __before bigint")
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + at).drop("__at", "__part", "__before")
