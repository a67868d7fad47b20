"""The tables behind exploration and figures: summaries, correlations, counts and histograms."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.storage import written
from tidewatch.operators import quantiles
from tidewatch.schema import FEATURES


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unpivoted(wide: DataFrame, rows: dict[str, dict[str, Column]], key: str = "feature") -> DataFrame:
    """One row for each key from a one-row table, in a single scan of what is below it."""
    items = [F.struct(F.lit(k).alias(key), *[c.alias(n) for n, c in named.items()]) for k, named in rows.items()]
    return wide.select(F.inline(F.array(*items)))


QUARTILES = (0.25, 0.5, 0.75)


def describe(data: DataFrame, columns=FEATURES, digits: int = 3) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each column, rounded."""
    data = written(data.select(*[F.col(c).cast("double").alias(c) for c in columns]), "describe")
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"count_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    quantile = quantiles.exact(data, dict.fromkeys(columns, QUARTILES))
    r = lambda x: F.round(x, digits) + F.lit(0.0)
    rows = {c: {"count": F.col(f"count_{c}"), "mean": r(F.col(f"mean_{c}")), "std": r(F.col(f"std_{c}")), "min": r(F.col(f"min_{c}")), **{f"q{round(100 * q)}": r(F.lit(quantile[c, q]).cast("double")) for q in QUARTILES}, "max": r(F.col(f"max_{c}"))} for c in columns}
    return unpivoted(data.agg(*aggs), rows)


def correlation(data: DataFrame, columns=FEATURES, digits: int = 6) -> DataFrame:
    """Pearson correlation of each pair in the lower triangle (feature_a before feature_b); null where undefined.

    Two passes: means and deviations, then one sum of products for each pair. Where a
    column has nulls, its pairs are taken over the rows in which both have values.
    """
    data = written(data.select(*[F.col(c).cast("double").alias(c) for c in columns]), "correlation")
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
    one = data.agg(F.count("*").alias("n"), *aggs).first()
    pairs = list(combinations(columns, 2))
    whole = {c for c in columns if one[f"n_{c}"] == one["n"]}
    flat = {c for c in columns if one[f"lo_{c}"] == one[f"hi_{c}"]}
    z = {c: (F.col(c) - F.lit(one[f"m_{c}"])) / F.lit(one[f"s_{c}"]) for c in whole - flat}
    plain = [(a, b) for a, b in pairs if a in z and b in z]
    rest = [(a, b) for a, b in pairs if not {a, b} <= whole and not {a, b} & flat]
    found = data.agg(F.lit(0), *[F.avg(z[a] * z[b]).alias(f"{a}/{b}") for a, b in plain], *[F.corr(a, b).alias(f"{a}/{b}") for a, b in rest]).first().asDict() if one["n"] else {}
    r = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))), digits) + F.lit(0.0)
    table = data.sparkSession.createDataFrame([(a, b, found.get(f"{a}/{b}")) for a, b in pairs], "feature_a string, feature_b string, r double")
    return table.withColumn("r", F.when(F.col("r").isNotNull() & ~F.isnan("r"), r))


def hours(data: DataFrame) -> DataFrame:
    """Rows by hour of day, all 24 hours, ascending."""
    counts = data.groupBy("hour").agg(F.count("*").alias("n"))
    return data.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n")).orderBy("hour")


def histogram(data: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins (the last closed on the right), empty ones included, with the 2 and 3 sigma marks.

    Equal values make one bin of width 1 from which all others are empty.
    """
    x = F.col(column).cast("double")
    values = data.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    limits = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    limits = limits.withColumn("width", width)
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = values.crossJoin(F.broadcast(limits)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row beside each
    frame = limits.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "*").filter("lo is not null")
    mark = lambda k: (F.col("mean") + k * F.coalesce("sd", F.lit(0.0))).alias(f"sigma_{k}")
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), mark(2), mark(3))


def split_histogram(data: DataFrame, column: str, flag: str, bins: int = 30) -> DataFrame:
    """Histogram over the range of all rows, counted apart for each value of ``flag``."""
    x = F.col(column).cast("double")
    values = data.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"), F.col(flag).alias("flag"))
    limits = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    joined = values.crossJoin(F.broadcast(limits.withColumn("width", width)))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    return joined.groupBy("flag", at.alias("bin"), (F.col("lo") + at * F.col("width")).alias("low")).agg(F.count("*").alias("n"))


def scatter(data: DataFrame) -> DataFrame:
    """Files against bytes, with the label."""
    return data.select("nb_files_accessed", "bytes_sent", *[c for c in ("label", "is_anomaly") if c in data.columns])


def users(data: DataFrame) -> DataFrame:
    """Distinct users in order of their first row."""
    return data.groupBy("username").agg(F.min("start_ts").alias("first_ts"), F.count("*").alias("sessions")).orderBy("first_ts", "username")


def summary(data: DataFrame) -> DataFrame:
    """Sessions, users and period of a data set in one row."""
    return data.agg(F.count("*").alias("sessions"), F.countDistinct("username").alias("users"), F.min("start_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def rates(data: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Share of rows in which each flag holds: (name, rate)."""
    wide = data.agg(*[F.avg(F.col(c).cast("int")).alias(n) for n, c in columns.items()])
    return unpivoted(wide, {n: {"rate": F.round(F.col(n), 6)} for n in columns}, "name")


def range_of(data: DataFrame, *columns: str) -> DataFrame:
    """Mean, least and greatest of score columns: (name, mean, min, max)."""
    wide = data.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    return unpivoted(wide, {c: {n: F.col(f"{n}_{c}") for n in ("mean", "min", "max")} for c in columns}, "name")


def head(data: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in an order."""
    return data.orderBy(*order).limit(n)
