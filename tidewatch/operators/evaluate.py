"""How verdicts compare with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.explore import unpivoted

LABELS = {0: "normal", 1: "insider", 2: "malware"}
RADAR = ("nb_files_accessed", "nb_sensitive_files", "nb_failed_logins", "nb_processes", "velocity", "entropy_commands")


def decoded(data: DataFrame) -> DataFrame:
    """``data`` with the name of its label; null for an unknown one."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return data.withColumn("label_name", F.try_element_at(names, F.col("label")))


def binary(data: DataFrame) -> DataFrame:
    return data.withColumn("is_attack", (F.col("label") > 0).cast("int"))


def label_counts(data: DataFrame) -> DataFrame:
    return data.agg(*[F.count_if(F.col("label") == k).alias(f"n_{n}") for k, n in LABELS.items()], F.count("*").alias("n"))


def vote_distribution(data: DataFrame) -> DataFrame:
    """Rows and share for 0 to 3 votes, zeros included."""
    counts = data.groupBy("votes").agg(F.count("*").alias("n"))
    total = F.sum("n").over(_whole())
    frame = data.sparkSession.range(4).select(F.col("id").cast("int").alias("votes"))
    full = frame.join(counts, "votes", "left").select("votes", F.coalesce("n", F.lit(0)).alias("n"))
    return full.select("votes", "n", F.round(F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)), 6).alias("share"))


def _whole():
    """All of a table of a few rows."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def label_votes(data: DataFrame) -> DataFrame:
    return decoded(data).groupBy("label_name", "votes").agg(F.count("*").alias("n"))


def confusion(data: DataFrame) -> DataFrame:
    """One row (tn, fp, fn, tp) from ``label`` and ``is_anomaly``."""
    bad, said = F.col("label") > 0, F.col("is_anomaly")
    return data.agg(F.count_if(~bad & ~said).alias("tn"), F.count_if(~bad & said).alias("fp"), F.count_if(bad & ~said).alias("fn"), F.count_if(bad & said).alias("tp"))


def over(a, b):
    """A quotient, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def report(data: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support of both classes, accuracy, plain and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    wide = confusion(data).withColumns({"p0": over(tn, tn + fn), "r0": over(tn, tn + fp), "p1": over(tp, tp + fp), "r1": over(tp, tp + fn), "s0": tn + fp, "s1": tp + fn})
    wide = wide.withColumns({f"f{k}": over(2 * F.col(f"p{k}") * F.col(f"r{k}"), F.col(f"p{k}") + F.col(f"r{k}")) for k in (0, 1)}).withColumn("n", F.col("s0") + F.col("s1"))
    r = lambda x: F.round(x, digits)
    rows = {name: {"precision": r(F.col(f"p{k}")), "recall": r(F.col(f"r{k}")), "f1": r(F.col(f"f{k}")), "support": F.col(f"s{k}")} for k, name in ((0, "normal"), (1, "attack"))}
    accuracy = r(over(tn + tp, F.col("n")))
    rows["accuracy"] = {"precision": accuracy, "recall": accuracy, "f1": accuracy, "support": F.col("n")}
    for name, weigh in (("macro avg", lambda m: (F.col(f"{m}0") + F.col(f"{m}1")) / 2), ("weighted avg", lambda m: over(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), F.col("n")))):
        rows[name] = {"precision": r(weigh("p")), "recall": r(weigh("r")), "f1": r(weigh("f")), "support": F.col("n")}
    return unpivoted(wide, rows, "class")


def rates(data: DataFrame) -> DataFrame:
    """Detection rate, precision and false-positive rate; null where undefined."""
    c = confusion(data)
    return c.select(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")).alias("fpr"))


def radar(data: DataFrame, columns=RADAR) -> DataFrame:
    """Mean of each feature by label over the feature's largest value of all rows."""
    top = data.agg(*[F.max(c).alias(f"top_{c}") for c in columns])
    means = data.groupBy("label").agg(*[F.avg(c).alias(c) for c in columns])
    joined = means.crossJoin(F.broadcast(top))  # one row beside each label
    items = [F.struct(F.lit(c).alias("feature"), F.round(F.col(c) / (F.col(f"top_{c}") + 1e-9), 6).alias("value")) for c in columns]
    return joined.select("label", F.inline(F.array(*items)))
