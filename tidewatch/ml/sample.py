"""Bounded samples for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(df: DataFrame, most: int, *columns: str, seed: int = 42) -> DataFrame:
    """The ``most`` rows of least seeded hash of ``columns`` (all rows, if fewer), in that order.

    Rows are first thinned by a bound on the hash that leaves about twice as many, so
    that what tasks send doesn't grow with their number.
    """
    h = F.xxhash64(*columns, F.lit(seed))
    n = df.count()
    if n > 4 * most:
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < int(2 * most / n * (1 << 30)))
        h = F.pmod(h, F.lit(1 << 30))
    return df.orderBy(h, *columns).limit(most)
