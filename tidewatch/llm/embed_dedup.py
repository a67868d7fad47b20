"""Near duplicates among embeddings: cross-polytope hashing with verified pairs.

1. Equal vectors (after normalising) are one group, compared later as one member.
2. In each of some tables (``tables_for``) a vector is rotated some times by three rounds of
   random signs and a fast Hadamard transform; each rotation gives the nearest
   vertex of the cross-polytope, and the vertices together the bucket. The number of
   rotations follows from that of vectors, so that a bucket has about ``FILL`` unrelated
   ones at most (``parts_for``). Besides its own bucket a vector probes those in which
   the ``PROBES`` next likely vertices replace one of its own. Buckets of more than
   ``LIMIT`` are divided by one more rotation, ``DEEPER`` times; there a vector goes to
   its two likeliest vertices.
3. Vectors that meet in a bucket are compared in blocks, in double precision, and
   linked at ``COSINE`` or more. Links join groups into components. A bucket of any
   size is compared whole.
4. Within each component all pairs are compared, in blocks, for the number of links.

Defined cases: vectors that are null, zero, or hold a null or non-finite component
link with nothing; so do vectors of different lengths with one another; rows that
repeat a vec_id are vectors of their own, shown with that id; an empty table gives
no rows. Labels and other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import cells, common

COSINE = 0.95
PROBES, SEED = 3, 5
#: Tables for the least number of rotations, more for each further one, and at most.
TABLES, MORE_TABLES, MOST_TABLES = 10, 2, 16
#: Unrelated vectors in a bucket, about, and rotations at least and at most.
FILL, PARTS, MOST_PARTS = 4, 2, 6
#: Vectors in a bucket beyond which it is divided, and how often.
LIMIT, DEEPER = 1024, 2
BLOCK = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def padded(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def parts_for(n: int, size: int, probes: int = PROBES) -> int:
    """Rotations of which the vertices make a bucket, for ``n`` vectors of padded length ``size``."""
    parts = PARTS
    while parts < MOST_PARTS and n * (1 + probes) > FILL * (2 * size) ** parts:
        parts += 1
    return parts


def tables_for(parts: int) -> int:
    """Tables that keep the recall at the threshold where buckets of more rotations lose more pairs."""
    return min(MOST_TABLES, TABLES + MORE_TABLES * (parts - PARTS))


def probe(x: np.ndarray, parts: int = PARTS, probes: int = PROBES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of unit rows, an int64 matrix with 1 + probes columns for each table (the table is in bits 6 to 9), and the two likeliest vertices of DEEPER more rotations for each table."""
    (n, d), tables = x.shape, tables_for(parts)
    size = padded(d)
    wide = np.zeros((n, size))
    wide[:, :d] = x
    out, deeper = np.empty((n, tables, 1 + probes), np.int64), np.empty((n, tables, DEEPER, 2), np.int64)
    for t in range(tables):
        rng = np.random.default_rng((seed, size, t))
        best = np.empty((n, parts), np.int64)
        swaps, loss = [], []
        for p in range(parts + DEEPER):
            y = rotate(wide, rng.choice((-1.0, 1.0), (3, size)))
            mag = np.abs(y)
            if p >= parts:
                top = np.argsort(-mag, axis=1, kind="stable")[:, :2]
                deeper[:, t, p - parts, : top.shape[1]] = top * 2 + (np.take_along_axis(y, top, axis=1) < 0)
                continue
            few = min(probes + 1, size)
            top = np.argsort(-mag, axis=1, kind="stable")[:, :few]
            value = np.take_along_axis(y, top, axis=1)
            vertex = top * 2 + (value < 0)
            best[:, p] = vertex[:, 0]
            swaps.append(vertex[:, 1:])
            loss.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))
        scale = (2 * size) ** np.arange(parts)
        own = best @ scale
        other = np.concatenate([own[:, None] + (s - best[:, p : p + 1]) * scale[p] for p, s in enumerate(swaps)], axis=1)
        pick = np.argsort(np.concatenate(loss, axis=1), axis=1, kind="stable")[:, :probes]
        found = np.concatenate((own[:, None], np.take_along_axis(other, pick, axis=1)), axis=1)
        out[:, t, : found.shape[1]] = found * 16 + t
        out[:, t, found.shape[1] :] = own[:, None] * 16 + t
    return out.reshape(n, -1) * 64 + size.bit_length(), deeper.reshape(n, -1)


def hashed(count: int):
    """Arrow function: (uid, key, embedding array<double>) to uid, key, unit, keys and deeper of one of ``count`` vectors; unusable ones have nulls."""

    def run(batches):
        for batch in batches:
            rows = batch.column(2).to_pylist()
            units, keys, deeper = [None] * len(rows), [None] * len(rows), [None] * len(rows)
            by_length: dict[int, list[int]] = {}
            for k, v in enumerate(rows):
                if v and None not in v:
                    by_length.setdefault(len(v), []).append(k)
            for length, places in by_length.items():
                x = np.array([rows[k] for k in places], np.float64)
                good = np.isfinite(x).all(axis=1)
                top = np.abs(np.where(good[:, None], x, 0)).max(axis=1)
                good &= top > 0
                x, at = x[good] / top[good, None], np.array(places)[good]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                if len(x):
                    for k, u, b, more in zip(at.tolist(), x, *probe(x, parts=parts_for(count, padded(length))), strict=True):
                        units[k], keys[k], deeper[k] = u.tobytes(), b, more
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(units, pa.binary()), pa.array(keys, longs), pa.array(deeper, longs)], ["uid", "key", "unit", "keys", "deeper"])

    return common.tidy(run)


def alike(cosine: float):
    def likeness(table: pa.Table) -> np.ndarray:
        raw = table.column("unit").to_pylist()
        out = np.zeros((len(raw), len(raw)), bool)
        for size in {len(u) for u in raw}:
            at = np.array([k for k, u in enumerate(raw) if len(u) == size])
            x = np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), -1)
            out[np.ix_(at, at)] = x @ x.T >= cosine
        return out

    def pairs(batch: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        raw = batch.column("unit").to_pylist()
        length = np.array([len(u) for u in raw])
        out = np.zeros(len(i), bool)
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            place = np.zeros(len(raw), np.int64)
            place[own] = np.arange(len(own))
            x = np.frombuffer(b"".join(raw[k] for k in own), np.float64).reshape(len(own), -1)
            both = np.flatnonzero((length[i] == size) & (length[j] == size))
            for k in range(0, len(both), 4096):
                at = both[k : k + 4096]
                out[at] = np.einsum("ij,ij->i", x[place[i[at]]], x[place[j[at]]]) >= cosine
        return out

    likeness.pairs = pairs
    return likeness


def buckets(scratch: common.Scratch, groups: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Members (id, b, n) of the buckets to compare, from ``groups(id, keys, deeper)``."""
    level, out = groups.select("id", F.explode(F.array_distinct("keys")).alias("b")), None
    for d in range(DEEPER + 1):
        sizes = level.groupBy("b").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(5))).alias("y")).filter("n > 1")
        sizes = scratch.write(sizes.groupBy("n", "x", "y").agg(F.min("b").alias("b")).select("b", "n"), f"sizes-{d}")
        inside = level.join(sizes, "b")
        got = (inside.filter(F.col("n") <= limit) if d < DEEPER else inside).select("id", "b", "n")
        out = got if out is None else out.unionByName(got)
        large = sizes.filter(F.col("n") > limit)
        if d == DEEPER or large.isEmpty():
            return out
        table = F.shiftright("b", 6).bitwiseAND(F.lit(15)).cast("int")
        into = [F.xxhash64("b", F.get("deeper", (table * DEEPER + d) * 2 + k)).bitwiseAND(F.lit(~1023)).bitwiseOR(F.col("b").bitwiseAND(F.lit(1023))) for k in range(2)]
        level = level.join(large.select("b"), "b").join(groups.select("id", "deeper"), "id")
        level = scratch.write(level.select("id", F.explode(F.array(*into)).alias("b")).distinct(), f"level-{d + 1}")


def dedup(scratch: common.Scratch, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Of ``vectors(key, embedding)``: one row per row with uid, key, n_links and component (least key of the component)."""
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), "key", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = vectors.schema["key"].dataType.simpleString()
    units = scratch.write(rows.mapInArrow(hashed(vectors.count()), f"uid bigint, key {kind}, unit binary, keys array<bigint>, deeper array<bigint>"), "units")
    groups = units.filter("unit is not null").groupBy("unit").agg(F.min("uid").alias("id"), F.count("*").alias("copies"), F.min("key").alias("least"), F.first("keys").alias("keys"), F.first("deeper").alias("deeper"))
    groups = scratch.write(groups, "groups")
    near = cells.dealt(buckets(scratch, groups), cells.blocks_for(F.col("n"), BLOCK)).drop("n").join(groups.select("id", "unit"), "id")
    edges = cells.compared(near, alike(cosine)).select("a", "b").distinct()
    parts = scratch.write(common.components(scratch, edges, "parts"), "components")
    inside = parts.select("id", F.col("root").alias("b")).join(groups.select("id", "unit", "copies"), "id")
    extent = parts.groupBy(F.col("root").alias("b")).agg(cells.blocks_for(F.count("*"), BLOCK).alias("nb"))
    judged = cells.compared(cells.dealt(inside.join(extent, "b"), F.col("nb")).drop("nb"), alike(cosine), "copies")
    links = judged.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    whole = groups.select("id", "unit", "copies", "least").join(parts, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = scratch.write(whole.select("unit", "root", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "whole")
    named = whole.join(whole.groupBy("root").agg(F.min("least").alias("component")), "root").select("unit", "component", "n_links")
    out = units.select("uid", "key", "unit").join(named, "unit", "left")
    return out.select("uid", "key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    out = dedup(common.Scratch(spark, "embed-dedup"), vectors)
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


#: All pairs by cosine, and what each vector reaches by links.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT rid, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda k: k IS NULL OR NOT isfinite(k))) = 0 AND list_max(list_transform(x, lambda k: abs(k))) > 0),
l AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.rid < b.rid WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= 0.95 ELSE false END),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, other) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a),
k AS (SELECT a AS rid, count(*) AS n_links FROM e GROUP BY a),
c AS (SELECT id AS rid, min(vec_id) AS least FROM reach JOIN v ON v.rid = other GROUP BY id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(least(vec_id, c.least), vec_id) AS component_id, coalesce(vec_id <= c.least, vec_id IS NOT NULL) AS kept
FROM v LEFT JOIN k USING (rid) LEFT JOIN c USING (rid)
"""
