"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Everything is SQL expressions. Base kinds (email, ip, card, phone) are reported
whenever their pattern and check hold. Further kinds (iban, ssn, tel) start from a
lower score that context words before the span raise; they are reported from
``KEEP`` up where they overlap no base span. An IBAN is confirmed by mod 97.

Patterns are possessive or guarded by look-behind, so that no run of characters is
scanned again from each of its positions and no loop recurses in the matcher.

Defined cases: a null text is empty and has no spans; rows that repeat an id are
judged one by one; an empty table gives no rows. Offsets are code points. Other columns
of the input are carried in ``row`` and may have any names. Overlaps are found by
binary search and context is taken from the pieces before a span, so the cost of a text
grows with its length and its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, spans

KEEP = 0.6

LOCAL = r"[A-Za-z0-9._%+-]"
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
ADDED = {"iban": 0.9, "ssn": 0.4, "tel": 0.4}
#: Context words of each added kind, and what one nearby adds to the score.
CONTEXT = {
    "iban": (r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", 0.1),
    "ssn": (r"(?i)\b(?:ssn|social security|tax id|taxpayer)\b", 0.4),
    "tel": (r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono)\b", 0.4),
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    weighed = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN, blanks aside, leaves 1 when divided by 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    figures = F.transform(F.split(turned, ""), lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(figures, F.lit(0), lambda r, x: (r * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def octets(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": octets,
    "card": lambda v: F.length(digits(v)).between(14, 19) & luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(10, 15),
    "iban": mod97,
    "ssn": lambda v: F.lit(True),
    "tel": lambda v: F.lit(True),
}


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns but the text), ``base`` and ``all``: arrays of (start, place, kind, end, value, score), in order."""
    body = F.col("text")
    may = {
        "email": body.contains("@"),
        "ip": body.rlike(r"[0-9]\.[0-9]"),
        "card": body.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": body.contains("+"),
        "iban": body.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{10}"),
        "ssn": body.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        "tel": body.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    }
    found = spans.located(spans.held(docs, text), {k: (PATTERNS[k], may[k]) for k in PATTERNS}, {k: words for k, (words, _) in CONTEXT.items()})

    def scored(kind: str) -> Column:
        place = list(PATTERNS).index(kind)
        good = F.filter(f"m_{kind}", lambda x: CHECKS[kind](x["value"]))
        score = lambda x: F.lit(1.0) if kind in BASE else F.lit(ADDED[kind]) + F.when(x["near"], F.lit(CONTEXT[kind][1])).otherwise(F.lit(0.0))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), score(x).alias("score")))

    found = found.withColumn("base", F.array_sort(F.concat(*map(scored, BASE))))
    found = found.withColumn("more", F.concat(*[F.filter(scored(k), lambda x: x["score"] >= KEEP) for k in ADDED]))
    found = spans.apart(found, "more", "base")
    found = found.withColumn("all", F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base")))
    return found.select("row", "base", "all")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [spans.number(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return found.select("row.doc_id", *count, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("all")).alias("spans"), (F.size("all") > 0).alias("has_personal_data"))
