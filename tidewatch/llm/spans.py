"""Places of regular-expression matches as SQL expressions: code-point offsets without a UDF.

A pattern's matches are wrapped in a mark that no pattern can match, the text is
split at the marks, and running sums of the pieces' lengths give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER = "\x01", "\x02"
#: Pieces whose sums are taken in one go: running sums cost n * CHUNK + (n / CHUNK)**2 instead of n**2.
CHUNK = 128

#: Code points before a span in which context words count, and the pieces that hold so many: half of them are matches, of 11 or more.
NEAR, PIECES = 48, 10

SPAN = "array<struct<start:bigint,end:bigint,value:string,near:boolean>>"


def pieces(text: Column, pattern: str) -> Column:
    """Text between matches and matches, alternating; [text] if there is no match."""
    free = F.translate(F.coalesce(text, F.lit("")), MARK, OTHER)
    return F.split(F.regexp_replace(free, pattern, f"{MARK}$0{MARK}"), MARK)


def running(values: Column, first: Column, op) -> Column:
    """``op`` over ``first`` and the elements before each element of arrays of positive size; past the last one more or none."""
    at = F.sequence(F.lit(0), F.ceil(F.size(values) / CHUNK).cast("int") - 1)

    def grow(acc, x):
        return F.concat(acc, F.array(op(F.element_at(acc, -1), x)))

    part = lambda b: F.slice(values, b * CHUNK + 1, F.lit(CHUNK))
    base = F.aggregate(F.transform(at, lambda b: F.aggregate(part(b), first, op)), F.array(first), grow)
    return F.flatten(F.zip_with(at, base, lambda b, from_: F.when(b.isNull(), F.array().cast("array<bigint>")).otherwise(F.slice(F.aggregate(part(b), F.array(from_), grow), 1, CHUNK))))


def starts(lengths: Column) -> Column:
    """Running sums before each element of a column of positive-size arrays of longs."""
    return running(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def matches(parts: Column, sums: Column, words: str | None = None) -> Column:
    """Spans of the matches among ``pieces``; ``near``: whether ``words`` match in the NEAR code points before."""
    every = F.zip_with(parts, F.slice(sums, 1, F.size(parts)), lambda p, s: F.struct(s.alias("start"), (s + F.char_length(p)).alias("end"), p.alias("value")))

    def near(i):  # from the pieces before, so that the text isn't scanned from its beginning for each match
        if words is None:
            return F.lit(False)
        from_ = F.greatest(i - PIECES, F.lit(0))
        return F.substring(F.array_join(F.slice(parts, from_ + 1, i - from_), ""), -NEAR, NEAR).rlike(words)

    own = F.transform(every, lambda x, i: F.when(i % 2 == 1, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), near(i).alias("near"))))
    return F.filter(own, lambda x: x.isNotNull())


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def held(docs: DataFrame, text: str) -> DataFrame:
    """``row``, a struct of every column but the text, which may have any names, and ``text``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*rest).alias("row"), F.col(f"`{text}`").alias("text"))


def located(df: DataFrame, patterns: dict[str, tuple[str, Column]], context: dict[str, str] | None = None) -> DataFrame:
    """``df`` with an array of spans ``m_<kind>`` for each kind: (pattern, a cheap condition that a match implies).

    Pieces, their running sums and the spans are columns of their own, so each is computed once.
    ``context`` has the words to look for before the spans of some kinds.
    """
    none = F.array().cast(SPAN)
    kinds = list(patterns)
    df = df.withColumns({f"p_{k}": F.when(F.coalesce(may, F.lit(False)), pieces(F.col("text"), rx)) for k, (rx, may) in patterns.items()})
    df = df.withColumns({f"l_{k}": F.when(F.size(f"p_{k}") > 1, F.transform(f"p_{k}", lambda p: F.char_length(p).cast("long"))) for k in kinds})
    df = df.withColumns({f"o_{k}": F.when(F.col(f"l_{k}").isNotNull(), starts(F.col(f"l_{k}"))) for k in kinds})
    df = df.withColumns({f"m_{k}": F.coalesce(F.when(F.col(f"o_{k}").isNotNull(), matches(F.col(f"p_{k}"), F.col(f"o_{k}"), (context or {}).get(k))), none) for k in kinds})
    return df.drop(*[f"{c}_{k}" for c in "plo" for k in kinds])


#: Halvings of a binary search: enough for any array.
HALVINGS = 31


def apart(df: DataFrame, spans: str, others: str) -> DataFrame:
    """``df`` with only those of column ``spans`` that overlap none of column ``others``, which is sorted by start.

    A span overlaps one of the others if, of those that start before its end, the
    largest end lies after its start: one binary search for each span.
    """
    long = lambda x: x.cast("long")
    some = (F.size(spans) > 0) & (F.size(others) > 0)
    df = df.withColumn("__s", F.when(some, F.transform(others, lambda y: long(y["start"]))))
    # the largest end before each of the others, and, by one element more, of all
    df = df.withColumn("__e", F.when(some, running(F.concat(F.transform(others, lambda y: long(y["end"])), F.array(F.lit(-1).cast("long"))), F.lit(-1).cast("long"), lambda a, x: F.greatest(a, x))))

    def before(x):
        """How many of the others start before the end of x."""
        first = F.struct(F.lit(0).alias("lo"), F.size("__s").alias("hi"))

        def half(acc, _):
            mid = F.shiftright(acc["lo"] + acc["hi"], 1)
            right = F.get(F.col("__s"), mid) < x["end"]
            go = acc["lo"] < acc["hi"]
            return F.struct(F.when(go & right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(go & ~right, mid).otherwise(acc["hi"]).alias("hi"))

        steps = F.sequence(F.lit(1), F.least(F.lit(HALVINGS), F.ceil(F.log2(F.size("__s") + 1)).cast("int") + 1))
        return F.aggregate(steps, first, half, lambda acc: acc["lo"])

    # a column that is used once would be moved into the lambda, and found anew for each span
    free = F.filter(spans, lambda x: F.get(F.col("__e"), before(x)) <= x["start"])
    return df.withColumn(spans, F.when(some & F.col("__e").isNotNull(), free).otherwise(F.col(spans))).drop("__s", "__e")


def number(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
