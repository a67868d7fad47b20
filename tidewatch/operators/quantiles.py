"""Exact quantiles of many columns without gathering their values in one task.

Ranks are found by narrowing: each pass counts the values of a range in ``BINS`` bins,
with partial sums, and goes on in the bin that holds the rank, until a bin holds one
value. What reaches the driver in a pass is at most ``BINS`` rows for each rank.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def long_form(data: DataFrame, columns) -> DataFrame:
    """(k, x): the place of each column in ``columns``, and its values as doubles, nulls and NaN left out."""
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    return data.select(F.inline(cells)).filter(F.col("x").isNotNull() & ~F.isnan("x"))


def order_statistics(values: DataFrame, ranks: dict[int, set[int]], extent: dict[int, tuple[float, float, int]], bins: int = BINS) -> dict[tuple[int, int], float]:
    """The values of 0-based ``ranks[k]`` in the order of ``values(k, x)``; ``extent[k]`` is least, greatest and count."""
    spark, found = values.sparkSession, {}
    # a range holds the ranks that still lie in it: (k, low, high, values below it) -> ranks
    todo = {(k, *extent[k][:2], 0): set(r) for k, r in ranks.items() if r}
    while todo:
        open_, now = [], todo
        for key, wanted in now.items():
            k, low, high, _ = key
            if low == high:
                found |= {(k, r): low for r in wanted}
            else:
                open_.append(key)
        if not open_:
            break
        # a range narrower than its bins can tell apart is cut behind its least value
        table = spark.createDataFrame([(i, k, low, high, (high - low) / bins) for i, (k, low, high, _) in enumerate(open_)], "i int, k int, low double, high double, width double")
        met = values.join(F.broadcast(table), "k").filter(F.col("x").between(F.col("low"), F.col("high")))  # one row for each rank at most
        place = F.when(F.col("width") > 0, F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")), F.lit(bins - 1))).otherwise((F.col("x") > F.col("low")).cast("long"))
        rows = met.groupBy("i", place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        todo = {}
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["i"], []).append(r)
        for i, some in by.items():
            k, _, _, below = open_[i]
            for r in sorted(some, key=lambda r: r["b"]):
                inside = {x for x in now[open_[i]] if below <= x < below + r["n"]}
                if inside:
                    todo.setdefault((k, r["lo"], r["hi"], below), set()).update(inside)
                below += r["n"]
    return found


def exact(data: DataFrame, shares: dict[str, tuple[float, ...]], bins: int = BINS) -> dict[tuple[str, float], float | None]:
    """Quantiles by linear interpolation between ranks: (column, share) to value; None where a column has no value.

    ``data`` is read once for the extents and once for each pass; keep it in a table if it is dear.
    """
    columns = list(shares)
    values = long_form(data, columns)
    extent = {r["k"]: (r["lo"], r["hi"], r["n"]) for r in values.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect()}
    at = {(k, q): q * (extent[k][2] - 1) for k, c in enumerate(columns) if k in extent for q in shares[c]}
    ranks: dict[int, set[int]] = {}
    for (k, _), place in at.items():
        ranks.setdefault(k, set()).update((math.floor(place), math.ceil(place)))
    found = order_statistics(values, ranks, extent, bins)
    out: dict[tuple[str, float], float | None] = {(c, q): None for c in columns for q in shares[c]}
    for (k, q), place in at.items():
        low, high = found[k, math.floor(place)], found[k, math.ceil(place)]
        out[columns[k], q] = low + (high - low) * (place - math.floor(place))
    return out
