"""Benchmark decontamination as a prefix-filtered set join with exact verification.

A window is ``window`` consecutive words of an item (the whole item if it has
fewer). Its set is its word shingles; a document that holds the window holds every
one of them, so with containment 1 the necessary prefix of a set in order of
rarity is its rarest shingle. Rarity is the number of occurrences over the whole
corpus. Documents are joined to windows by these prefix shingles alone; the
position of the shingle in the window gives the only place at which the window can
stand (positional bound), which must lie within the document (length bound), and
the words there are compared with the window's.

Two scans of the texts: one counts benchmark shingles, one finds prefix shingles, each
place of one a row of its own.
A bitmap of at most ``MAX_BITS`` bits, whatever the benchmark's size, keeps other
shingles from leaving the scan; what it lets pass wrongly is dropped by the joins.

Defined cases: null or wordless texts have no words and hit nothing; null or
wordless items have no windows; items that repeat an item_id count once; each row
of a repeated doc_id is judged by its own text; empty tables give no hits; ``clean`` holds
the input in one struct, so its columns may have any names, and ``report`` reads key and
text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.words import words

WINDOW, SHINGLE = 10, 5
MIN_BITS, MAX_BITS = 1 << 20, 1 << 26


def cut_items(window: int, shingle: int):
    """Arrow function: items to windows (item_id, n, k, text, grams); k is the length of the shingles."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for block in words(batch.column(1)):
                for row in range(block.last - block.first):
                    lo, hi = block.bounds[row], block.bounds[row + 1]
                    n = int(min(window, hi - lo))
                    if not n:
                        continue
                    k = min(shingle, n)
                    hashes, _, bounds = block.grams(k)
                    for at in range(lo, hi - n + 1):
                        first = bounds[row] + at - lo
                        out.append((ids[block.first + row] or "", n, k, block.text(at, at + n), hashes[first : first + n - k + 1].view(np.int64).tolist()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())), strict=True)], ["item_id", "n", "k", "text", "grams"])

    return run


def bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """Bits of the scrambled shingles of ``grams(g)``, gathered as at most bits / 64 rows."""
    at = F.col("g").bitwiseAND(F.lit(bits - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    rows = grams.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(mask).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def found_in(block, k: int, flags: np.ndarray):
    hashes, at, bounds = block.grams(k)
    hit = np.flatnonzero(flags[(hashes & np.uint64(len(flags) - 1)).astype(np.int64)])
    return hashes[hit], at[hit], np.searchsorted(bounds, hit, side="right") - 1


def count_grams(ks: list[int], flags):
    """Arrow function: texts to occurrences of flagged shingles (g, n), summed by batch."""

    def run(batches):
        for batch in batches:
            parts = [found_in(block, k, flags.value)[0] for block in words(batch.column(0)) for k in ks]
            g, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

    return run


#: Rows of a text: one with its key and n_words, and one for each place of a flagged shingle.
FOUND = "n_words bigint, g bigint, at bigint, from_at bigint, near string"


def find_grams(ks: list[int], flags, window: int):
    """Arrow function: (uid, key, text) to FOUND; a place (shingle g at word ``at``) comes with the words around, from ``from_at`` on."""

    def run(batches):
        for batch in batches:
            for block in words(batch.column(2)):
                n = np.diff(block.bounds)
                rows = np.arange(block.first, block.last)
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:2]), pa.array(n), none, none, none, pa.nulls(len(rows), pa.string())], names)
                for k in ks:
                    g, at, row = found_in(block, k, flags.value)
                    for lo in range(0, len(g), PLACES):
                        yield places(batch, block, g[lo : lo + PLACES], at[lo : lo + PLACES], row[lo : lo + PLACES], n)

    def places(batch, block, g, at, row, n):
        low, high = block.bounds[row], block.bounds[row + 1]
        a, b = np.maximum(low, at - window + 1), np.minimum(high, at + window)
        near = [bytes(block.data[x:y]).decode("utf-8", "replace") for x, y in zip(block.starts[a].tolist(), block.ends[b - 1].tolist(), strict=True)]
        held = [c.take(pa.array(block.first + row)) for c in batch.columns[:2]]
        return pa.RecordBatch.from_arrays([*held, pa.array(n[row]), pa.array(g.view(np.int64)), pa.array(at - low), pa.array(a - low), pa.array(near, pa.string())], names)

    names = ["uid", "key", "n_words", "g", "at", "from_at", "near"]
    return common.tidy(run)


#: Places in a batch that leaves a scan.
PLACES = 4096


def judge(scratch: common.Scratch, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs(key, text)`` and ``benchmark(item_id, text)``: rows (uid, key, n_words), hits (uid, start, n), items (uid, item_id)."""
    spark = scratch.spark
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    wins = scratch.write(items.mapInArrow(cut_items(window, shingle), "item_id string, n int, k int, text string, grams array<bigint>"), "windows")
    grams = wins.select(F.explode("grams").alias("g")).distinct()
    n_grams = grams.count()
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (64 * n_grams).bit_length()))
    ks = [r.k for r in wins.select("k").distinct().collect()]  # at most ``shingle`` values
    flags = spark.sparkContext.broadcast(bitmap(grams, bits))
    seen = docs.select("text").mapInArrow(common.tidy(count_grams(ks, flags)), "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    counts = scratch.write(grams.join(seen, "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("df")), "rarity")
    places = wins.select("text", "n", F.posexplode("grams").alias("off", "g")).join(counts, "g")
    prefix = places.groupBy("text", "n").agg(F.min(F.struct("df", "g", "off")).alias("p")).select("text", "n", F.col("p.g").alias("g"), F.col("p.off").alias("off"))
    prefix = scratch.write(prefix, "prefix")
    flags = spark.sparkContext.broadcast(bitmap(prefix.select("g").distinct(), bits))
    key = docs.schema["key"].dataType.simpleString()
    each = docs.select(F.monotonically_increasing_id().alias("uid"), "key", "text").mapInArrow(find_grams(ks, flags, window), f"uid bigint, key {key}, {FOUND}")
    each = scratch.write(each, "rows")  # one scan gives both, so a text and its places have the same uid
    rows, near = each.filter("g is null").select("uid", "key", "n_words"), each.filter("g is not null").drop("key")
    start = F.col("at") - F.col("off")
    near = near.join(common.small(prefix), "g").filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    there = F.slice(F.split("near", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (start - F.col("from_at") + 1).cast("int"), F.col("n"))
    hits = scratch.write(near.filter(F.array_join(there, " ") == F.col("text")).select("uid", start.alias("start"), "n", "text"), "hits")
    named = hits.join(common.small(wins.select("text", "item_id").distinct()), "text").select("uid", "item_id").distinct()
    return rows.select("uid", "key", "n_words"), hits.select("uid", "start", "n").distinct(), named


def covered(hits: DataFrame) -> DataFrame:
    """Words of each document inside its windows: the length of the union of (start, n)."""
    before = Window.partitionBy("uid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    own = end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))
    return hits.select("uid", F.greatest(own, F.lit(0)).alias("own")).groupBy("uid").agg(F.sum("own").alias("n_hit"))


def report(scratch: common.Scratch, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, items (sorted ids), contaminated."""
    rows, hits, items = judge(scratch, docs, benchmark, window, shingle)
    named = items.groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = rows.join(covered(hits), "uid", "left").join(named, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def clean(scratch: common.Scratch, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, with their own columns."""
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows, hits, _ = judge(scratch, docs.select(sha.alias("key"), F.col(text).alias("text")), benchmark, window, shingle)
    bad = scratch.write(rows.join(hits.select("uid").distinct(), "uid", "left_semi").select(F.col("key").alias("sha")).distinct(), "bad")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), sha.alias("sha"))
    return held.join(common.small(bad), "sha", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    out = report(common.Scratch(spark, "decontaminate"), docs, common.table(spark, sf_dir, "benchmark"))
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bi),
di AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
hits AS (SELECT rid, i, d.n, item_id FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM di) d JOIN wins ON d.n = wins.n AND d.t = wins.t),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
