"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash of its id. A source that is to give ``target``
words out of ``source_size`` is taken ``floor(target / source_size)`` times as a
whole, and the rest of its budget is met by the documents whose hash is at or
below a threshold. Thresholds of growing budgets are nested, so a larger budget
only adds documents. The threshold is found without sorting documents: words are
summed by source and hash bucket, the bucket in which the running sum passes the
budget is divided into finer buckets, and within that fine bucket the sums by
hash give the place. Of the two places around the budget the nearer is taken.
Thresholds meet documents by broadcast where the sources are few enough, so a hot
source stays in the tasks that read it.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; rows that repeat a doc_id share a hash and are taken together; a null
doc_id hashes as the empty text; an empty table gives no rows. Other columns of
the input are carried in ``row`` and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common

WEIGHTS = (1, 2, 3)
CAP = 3
#: Bits of the hash, of its coarse bucket and of its fine bucket.
BITS, COARSE, FINE = 60, 12, 24


def size_of(text: Column) -> Column:
    """Number of words parted by ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row`` with every column but the text, and source, size and hash of each document."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*rest).alias("row"), F.col(source).isNull().alias("s_null"), F.coalesce(F.col(source), F.lit("")).alias("s"), size_of(F.col(text)).alias("size"), hash_of(F.col(key)).alias("h"))


def budgets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets of ``sources(s_null, s, source_size)``: shares by weight of all words, none above ``cap`` times its source.

    The shared-out excess ends where ``sum(min(cap * size, level * weight))`` equals all
    words; sources are taken by growing ``cap * size / weight`` until the level fits.
    The windows run over one row per source, not over documents.
    """
    order = Window.orderBy("s_null", "s")
    given = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    given = given.withColumn("most", F.col("source_size").cast("double") * F.lit(float(cap)))
    full = Window.orderBy(F.col("most") / F.col("weight"), "s_null", "s")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    given = given.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    given = given.withColumn("level", F.max(fits).over(everything))
    # above the level of the first source that fits, sources are at their most
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return given.select("s_null", "s", "source_size", target.alias("target"))


def plan(scratch: common.Scratch, slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """For each source of ``slim(s_null, s, size, h)``: source_size, target, whole repeats and the hash threshold."""
    by = ["s_null", "s"]
    coarse = F.shiftright("h", BITS - COARSE)
    fine = F.shiftright("h", BITS - FINE)
    first = scratch.write(slim.groupBy(*by, coarse.alias("b")).agg(F.sum("size").alias("size")), "coarse")
    goal = budgets(first.groupBy(*by).agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = scratch.write(goal, "goal")

    def boundary(sums: DataFrame, base: DataFrame) -> DataFrame:
        """The bucket of each source in which the running sum passes its rest, and the sum before it."""
        w = Window.partitionBy(*by).orderBy("b")
        up = sums.join(base, by).withColumn("upto", F.col("base") + F.sum("size").over(w))
        return up.filter((F.col("upto").cast("double") > F.col("rest")) & ((F.col("upto") - F.col("size")).cast("double") <= F.col("rest"))).select(*by, F.col("b").alias("at"), (F.col("upto") - F.col("size")).alias("base"), "rest")

    edge = scratch.write(boundary(first, goal.select(*by, "rest", F.lit(0).cast("long").alias("base"))), "edge-coarse")
    second = slim.join(common.small(edge), by).filter(coarse == F.col("at")).groupBy(*by, fine.alias("b")).agg(F.sum("size").alias("size"))
    edge = scratch.write(boundary(second, edge.select(*by, "rest", "base")), "edge-fine")
    last = slim.join(common.small(edge), by).filter(fine == F.col("at")).groupBy(*by, F.col("h").alias("b")).agg(F.sum("size").alias("size"))
    edge = boundary(last, edge.select(*by, "rest", "base")).join(last.withColumnRenamed("b", "at"), [*by, "at"])
    # the nearer of the places before and after the hash at which the budget is passed
    over = F.col("base") + F.col("size") - F.col("rest")
    edge = edge.select(*by, F.when(over < F.col("rest") - F.col("base"), F.col("at")).otherwise(F.col("at") - 1).alias("threshold"))
    return goal.join(edge, by, "left").select(*by, "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1).cast("long")).alias("threshold"))


def copies(whole: Column, threshold: Column, h: Column) -> Column:
    return whole + (h <= threshold).cast("long")


def mix(scratch: common.Scratch, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row`` (all columns but the text), size, source_size, target, copies and taken of every document."""
    slim = scratch.write(measured(docs, key, text, source), "slim")
    found = scratch.write(plan(scratch, slim, weights, cap), "plan")
    taken = copies(F.col("whole"), F.col("threshold"), F.col("h"))
    return slim.join(common.small(found), ["s_null", "s"]).select("row", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"))


def mixed_rows(scratch: common.Scratch, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    slim = scratch.write(measured(docs).drop("row"), "slim")
    found = scratch.write(plan(scratch, slim, weights, cap), "plan")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s"), hash_of(F.col("doc_id")).alias("h"))
    times = copies(F.col("whole"), F.col("threshold"), F.col("h")).cast("int")
    return keyed.join(common.small(found), ["s_null", "s"]).filter(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(common.Scratch(spark, "mixing"), docs)
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


#: The same mix over any table with doc_id, text and source; {docs} names it.
SQL = r"""
m AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         source IS NULL AS s_null, coalesce(source, '') AS s,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM {docs}),
t AS (SELECT s_null, s, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY ALL),
w AS (
  SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY s_null, encode(s)) - 1) % 3 + 1] AS DOUBLE) AS weight,
         CAST(source_size AS DOUBLE) * 3.0 AS most FROM t),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(most) OVER (ORDER BY most / weight, s_null, encode(s) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY most / weight, s_null, encode(s) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (
  SELECT s_null, s, source_size,
         least(most, coalesce(max(CASE WHEN level <= most / weight THEN level END) OVER () * weight, most)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
c AS (
  SELECT m.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         CAST(sum(size) OVER (PARTITION BY m.s_null, m.s ORDER BY h) AS BIGINT) AS upto,
         CAST(sum(size) OVER (PARTITION BY m.s_null, m.s, h) AS BIGINT) AS own
  FROM m JOIN r ON m.s_null = r.s_null AND m.s = r.s),
mixed AS (
  SELECT *, whole + CASE WHEN upto <= rest AND rest > 0 OR upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END AS copies FROM c)
"""

ORACLE = f"WITH {SQL.format(docs='documents')} SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"
