"""How a session compares with its user's own: z-scores over all or over recent sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.scalar import even
from tidewatch.schema import DATASET

#: Source column of each z-score.
Z = {"z_score_files": "nb_files_accessed", "z_score_logins": "nb_failed_logins"}


def z_over(column: str, frame: WindowSpec) -> Column:
    """Distance from the frame's mean in sample deviations; 0 for one row or equal rows."""
    x = F.col(column)
    flat = (F.count(x).over(frame) <= 1) | (F.max(x).over(frame) == F.min(x).over(frame))
    return F.coalesce(F.when(flat, 0.0).otherwise(even((x - F.avg(x).over(frame)) / F.stddev_samp(x).over(frame), 4)), F.lit(0.0))


def user_zscores(features: DataFrame, skewed: bool = False) -> DataFrame:
    """Both z-scores over all of a user's rows; a missing source column gives 0.

    ``skewed`` sums by user and joins the sums back, which AQE can split, in place of
    a window that keeps each user in one task.
    """
    here = {z: c for z, c in Z.items() if c in features.columns}
    out = features.withColumns({z: F.lit(0.0) for z in Z if z not in here})
    if not skewed:
        return out.withColumns({z: z_over(c, Window.partitionBy("username")) for z, c in here.items()})
    sums = [f(c).alias(f"__{n}_{c}") for c in here.values() for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("avg", F.avg), ("sd", F.stddev_samp))]
    joined = out.join(features.groupBy(F.col("username").alias("__user")).agg(*sums), F.col("username").eqNullSafe(F.col("__user")))
    for z, c in here.items():
        flat = (F.col(f"__n_{c}") <= 1) | (F.col(f"__lo_{c}") == F.col(f"__hi_{c}"))
        joined = joined.withColumn(z, F.coalesce(F.when(flat, 0.0).otherwise(even((F.col(c) - F.col(f"__avg_{c}")) / F.col(f"__sd_{c}"), 4)), F.lit(0.0)))
    return joined.select(*out.columns, *here)


def rolling_zscores(features: DataFrame, history: int = 500) -> DataFrame:
    """Both z-scores over the user's sessions among the last ``history`` of all users and the present one; needs ``seq``.

    Rows are dealt by user and block of ``history`` numbers, each block with the numbers
    of the block before beside it, so no user is more than a block's rows in a task.
    """
    block = F.floor(F.col("seq") / F.lit(max(history, 1)))
    rows = features.withColumns({"__block": block, "__own": F.lit(True)})
    before = features.select("username", "seq", *Z.values(), (block + 1).alias("__block"), F.lit(False).alias("__own"))
    frame = Window.partitionBy("username", "__block").orderBy("seq").rangeBetween(-history, 0)
    both = rows.unionByName(before, allowMissingColumns=True)
    return both.withColumns({z: z_over(c, frame) for z, c in Z.items()}).filter("__own").drop("__block", "__own")


def dataset(features: DataFrame) -> DataFrame:
    """The exported columns that are there, in order."""
    return features.select(*[c for c in DATASET if c in features.columns])
