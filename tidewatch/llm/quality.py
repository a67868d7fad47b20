"""Quality scores learned from preference pairs (Bradley-Terry), cut at a score quantile.

A document of label 1 is preferred to one of label 0. The weight vector maximises
the likelihood ``sigmoid(w . (x1 - x0))`` of such pairs, with x the shape of the
text alone: rates of characters, words and repeats. The cut is the quantile of the
scores of all labelled training rows that leaves below it the share of label 0;
scores are mapped to 0..1 so that the cut lies at ``CUT``.

Features come from one scan in Arrow batches. The fit uses at most ``MAX_FIT`` rows
of each label, those with the least hash of their id, and runs on the driver. The
cut takes every labelled training row: they are scored in Spark, and histograms
narrow the range of the cut until at most ``FEW`` different scores are sent.

Defined cases: a null or empty text has all-zero features and is scored like any
other; labels that repeat a doc_id are averaged, and 0.5 or more is 1; null labels
and labels of unknown documents are skipped; each row of a repeated doc_id is
scored by its own text; ``keep`` holds the input in one struct, so its columns may have any names; if only one label, or none, is seen, every score is 1.0 for
label 1 or none and 0.0 for label 0; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.words import BLOCK, blocks, text_buffers, words_of

MAX_FIT, PAIRS, RIDGE, SEED = 10_000, 100_000, 1.0, 11
CUT = 0.7
BINS, FEW = 4096, 4096

PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
NAMES = ["words", "word_length", "distinct", "repeats", "short", "long", "line_words", "line_repeats", "upper", "lower", "digit", "newline", "blank", "wide", *(f"char_{c}" for c in PUNCTUATION)]


def features(column: pa.Array) -> np.ndarray:
    """Rows of features (float64) of a text column; see NAMES."""
    offsets, data = text_buffers(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for first, last in blocks(offsets):
        rows = last - first
        block = words_of(offsets[first : last + 1], data, first, last)
        raw = data[offsets[first] : offsets[last]]
        if rows > 1:
            row_of = np.repeat(np.arange(rows), np.diff(block.offsets))
            counts = np.bincount(row_of * 256 + raw, minlength=rows * 256).reshape(rows, 256)
        else:  # a text of any length, part by part
            counts = sum((np.bincount(raw[a : a + BLOCK], minlength=256) for a in range(0, len(raw), BLOCK)), np.zeros(256, np.int64))[None]
        size = np.maximum(np.diff(block.offsets), 1)[:, None]
        f = out[first:last]
        n = np.diff(block.bounds)
        some = np.maximum(n, 1)
        word_row = np.repeat(np.arange(rows), n)
        lengths = block.ends - block.starts
        per = lambda mask: np.bincount(word_row, weights=mask, minlength=rows)
        order = np.lexsort((block.hashes, word_row))
        h, w = block.hashes[order], word_row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        again = np.zeros(len(h), bool)
        again[1:] = (block.hashes[1:] == block.hashes[:-1]) & (word_row[1:] == word_row[:-1])
        f[:, 0] = np.log1p(n)
        f[:, 1] = per(lengths) / some
        f[:, 2] = np.bincount(w, weights=new, minlength=rows) / np.sqrt(some)
        f[:, 3] = np.sqrt(per(again) / some)
        f[:, 4] = per(lengths <= 2) / some
        f[:, 5] = per(lengths >= 12) / some
        f[:, 6] = np.log1p(n / (counts[:, 10] + 1))
        f[:, 7] = np.log1p(counts[:, 10])
        groups = [range(65, 91), range(97, 123), range(48, 58), [10], [32], range(128, 256)]
        for k, g in enumerate(groups):
            f[:, 8 + k] = np.sqrt(counts[:, list(g)].sum(axis=1) / size[:, 0])
        f[:, 14:] = np.sqrt(counts[:, PUNCTUATION] / size)
        f[np.diff(block.offsets) == 0] = 0
    return out


def extract(batches):
    for batch in batches:
        x = features(batch.column(1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["key", "x"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Weights from feature rows of label 1 and of label 0, by Newton steps on the pair loss; the cut is left at 0."""
    if not len(good) or not len(bad):
        return Model(np.zeros(0), np.ones(0), np.zeros(0), 0.0, 0.0 if len(bad) else 1.0)
    both = np.concatenate((good, bad))
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-6] = 1.0
    good, bad = (good - mean) / scale, (bad - mean) / scale
    rng = np.random.default_rng(seed)
    diff = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(good.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = diff.T @ p - ridge * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, 0.0)


def ranked(values: DataFrame, rank: int) -> float:
    """The value of 0-based ``rank`` in the order of ``values(s)``, finite doubles; exact.

    Each pass counts the values of a range in ``BINS`` bins and goes on in the one that
    holds the rank, until ``FEW`` different values, or those of one point, are left.
    """
    low, high, n = values.agg(F.min("s"), F.max("s"), F.count("*")).first()
    below = 0  # values under the range
    while low < high and n > FEW:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("s") - low) / width), F.lit(BINS - 1)) if width > 0 else F.when(F.col("s") > low, 1).otherwise(0)
        bins = values.filter(F.col("s").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("b").collect()
        for r in bins:
            if below + r["n"] > rank:
                break
            below += r["n"]
        low, high, n = r["low"], r["high"], r["n"]
    for r in values.filter(F.col("s").between(low, high)).groupBy("s").count().orderBy("s").collect() if low < high else []:
        if below + r["count"] > rank:
            return r["s"]
        below += r["count"]
    return low


def cut_of(scratch: common.Scratch, rows: DataFrame, model: Model, n_bad: int, n: int) -> float:
    """Halfway between the scores of ranks ``n_bad`` and ``n_bad + 1`` among the ``n`` of ``rows(x)``."""

    def raw(batches):
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x))], ["s"])

    values = scratch.write(rows.select("x").mapInArrow(raw, "s double"), "raw")
    return (ranked(values, n_bad - 1) + ranked(values, min(n_bad, n - 1))) / 2


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def learn(scratch: common.Scratch, found: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Fit on ``found(key, x)`` and ``labels(key, label)``, held-out keys aside."""
    given = labels.filter(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key"))).groupBy("key").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    rows = scratch.write(found.join(given, "key").select("key", "label", "x"), "fit")
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = []
    for label in (1, 0):
        bound = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30))
        own = rows.filter(F.col("label") == label)
        if (n := count.get(label, 0)) > 4 * max_fit:  # thinned first, so that what tasks send doesn't grow with their number
            own = own.filter(bound < int(2 * max_fit / n * (1 << 30)))
        few = own.orderBy(bound, "key", "x").limit(max_fit).select("x").toArrow().column("x").combine_chunks()
        parts.append(np.asarray(few.flatten(), np.float64).reshape(len(few), -1) if len(few) else np.zeros((0, len(NAMES))))
    model = fit(*parts)
    if model.constant is None:
        model.cut = cut_of(scratch, rows, model, count[0], sum(count.values()))
    return model


def apply(model: Model, at: int):
    """Arrow function: batches of one struct column to that and ``__score``, of the text at place ``at`` in it."""

    def run(batches):
        for batch in batches:
            score = model.scores(features(batch.column(0).field(at))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["row", "__score"])

    return common.tidy(run)


def labelled(labels: DataFrame, label: str = "quality") -> DataFrame:
    return labels.select(F.col("doc_id").alias("key"), F.col(label).alias("label"))


def keep(scratch: common.Scratch, docs: DataFrame, labels: DataFrame, cut: float = CUT, max_fit: int = MAX_FIT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with their own columns."""
    model = learn(scratch, docs.select("doc_id", "text").mapInArrow(common.tidy(extract), f"key {docs.schema['doc_id'].dataType.simpleString()}, x array<float>"), labelled(labels), max_fit)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scored = held.mapInArrow(apply(model, docs.columns.index("text")), f"row {held.schema['row'].dataType.simpleString()}, __score double")
    return scored.filter(F.col("__score") >= cut).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = common.Scratch(spark, "quality")
    found = scratch.write(docs.mapInArrow(common.tidy(extract), "key bigint, x array<float>"), "features")
    model = learn(scratch, found, labelled(common.table(spark, sf_dir, "labels")))

    def score(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    out = found.mapInArrow(score, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
