"""Secrets: assignment, key and hex patterns, and character Markov models for the rest.

Two first-order models over ``ALPHABET`` are trained from labelled samples, one of
random strings and one of ordinary identifiers. A token outside the base spans is a
secret if the log-likelihood ratio of the models over its characters is at least
``TOTAL`` and at least ``EACH`` for each character. Tokens have a letter, and an
upper-case letter or a digit; any length is judged, but those too short to reach the
thresholds under the models (see ``shortest``) aren't proposed.

Defined cases: a null text is empty and has no spans; rows that repeat an id are
judged one by one; an empty table gives no rows; characters outside the alphabet
share one symbol. Offsets are code points. Other columns of the input are carried in
``row`` and may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, spans

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SYMBOLS = len(ALPHABET) + 1
TOTAL, EACH = 12.0, 0.75
#: Labelled samples of each label when the caller gives none.
SAMPLES = 4000

BASE = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])(?=[a-z+/_=-]*+[0-9A-Z])[A-Za-z0-9+/_=-]",  # times shortest() or more
}
#: From this length on tokens are proposed whatever the models.
ALWAYS = 16
#: Words of which ordinary identifiers are made in the default samples.
WORDS = """account action address amount array batch buffer build cache client code column command config connection content
context count create current customer data default delete device document driver element engine error event executor field
file filter format function group handler header history identifier image index information input instance interface internal
invoice item language latest length level library limit list location manager market measure memory message method model
module month name network number object operation option order output package page parameter partition password payment
period person phone policy position previous price process product project property provider public quality query queue
random range reader record region register report request resource response result return sample schema search security
select server service session setting signal source status storage stream string summary supplier system table target
template thread through time token total transaction transfer translation type update upload value variable version view
warehouse window worker writer""".split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled strings (text, random): digests in base 64, hex and base 32 alphabets, and identifiers made of words."""
    ids = spark.range(n)
    digest = F.unhex(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256))
    b64 = F.base64(digest)
    rand = ids.select(F.when(F.col("id") % 4 == 0, F.lower(F.hex(digest))).when(F.col("id") % 4 == 1, F.upper(F.translate(b64, "+/=", ""))).when(F.col("id") % 4 == 2, F.translate(b64, "+/=", "")).otherwise(F.translate(b64, "+/=", "-_")).alias("text"), F.lit(True).alias("random"))
    words = F.array(*map(F.lit, WORDS))

    def word(k):
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))

    a, b, c = word(1), word(2), word(3)
    kind = F.col("id") % 6
    name = F.when(kind == 0, F.concat_ws("_", a, b, c)).when(kind == 1, F.concat(a, F.initcap(b), F.initcap(c))).when(kind == 2, F.upper(F.concat_ws("_", a, b))).when(kind == 3, F.concat_ws("-", a, b, c)).when(kind == 4, F.concat(a, b, F.lit("_"), (F.col("id") % 100).cast("string"))).otherwise(F.concat(F.initcap(a), F.initcap(b), F.initcap(c)))
    return rand.unionByName(ids.select(name.alias("text"), F.lit(False).alias("random")))


def symbol(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def train(labelled: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair of symbols from ``labelled(text, random)``; a null text is skipped.

    Pairs are counted in Spark; at most 2 * SYMBOLS**2 counts reach the driver.
    """
    chars = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), symbol)
    with_ids = labelled.filter("text is not null").select("random", chars.alias("c"))
    pairs = F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = with_ids.select("random", F.explode(pairs).alias("p")).groupBy("random", "p.a", "p.b").count().collect()
    counts = np.ones((2, SYMBOLS, SYMBOLS))
    for r in rows:
        counts[int(r["random"]), r["a"], r["b"]] += r["count"]
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).ravel()


def shortest(weights: np.ndarray) -> int:
    """The least length at which some token reaches both thresholds, ``ALWAYS`` at most: no shorter token can be a secret."""
    use = [k for k, c in enumerate(ALPHABET, 1) if c != "."]  # what PATTERNS["random"] matches
    pair = weights.reshape(SYMBOLS, SYMBOLS)[np.ix_(use, use)]
    best = np.zeros(len(use))  # by last symbol
    for n in range(2, ALWAYS):
        best = (best[:, None] + pair).max(axis=0)
        if best.max() >= max(TOTAL, EACH * n) - 1e-9:
            return n
    return ALWAYS


def ratio(value: Column, model: Column) -> Column:
    """Log-likelihood ratio of a text under ``model``."""
    first = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum"))

    def step(acc, x):
        more = F.when(acc["at"] >= 0, F.get(model, acc["at"] * SYMBOLS + x)).otherwise(F.lit(0.0))
        return F.struct(x.alias("at"), (acc["sum"] + more).alias("sum"))

    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), symbol)
    return F.aggregate(codes, first, step, lambda acc: acc["sum"])


def find(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``row`` (all columns but the text), ``base`` and ``all``: arrays of (start, place, kind, end, value, score), in order."""
    weights = train(labelled if labelled is not None else samples(docs.sparkSession))
    body = F.col("text")
    patterns = PATTERNS | {"random": f"{PATTERNS['random']}{{{shortest(weights)},}}+"}
    may = {
        "assign": body.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
        "access": body.contains("AKIA"),
        "hex": body.rlike("[0-9a-f]{24}"),
        "random": body.rlike(patterns["random"]),
    }
    found = spans.located(spans.held(docs, text), {k: (patterns[k], may[k]) for k in patterns})
    checks = {
        "assign": lambda v: F.length(F.regexp_extract(v, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)) >= 6,
        "access": lambda v: F.length(v) >= 20,
        "hex": lambda v: F.lit(True),
    }

    def passing(kind: str) -> Column:
        return F.filter(f"m_{kind}", lambda x: checks[kind](x["value"]))

    def spanned(kind: str, values: Column, score) -> Column:
        place = list(PATTERNS).index(kind)
        return F.transform(values, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), score(x).alias("score")))

    found = found.withColumn("base", F.array_sort(F.concat(*[spanned(k, passing(k), lambda x: F.lit(1.0)) for k in BASE])))
    found = spans.apart(found, "m_random", "base")
    model = F.lit(weights)
    more = spanned("random", F.col("m_random"), lambda x: ratio(x["value"], model))
    found = found.withColumn("more", more)
    found = found.withColumn("more", F.filter("more", lambda x: (x["score"] >= TOTAL) & (x["score"] >= EACH * F.length(x["value"]))))
    found = found.withColumn("all", F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base")))
    return found.select("row", "base", "all")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [spans.number(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return found.select("row.doc_id", *count, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("all")).alias("spans"), (F.size("all") > 0).alias("has_secret"))
