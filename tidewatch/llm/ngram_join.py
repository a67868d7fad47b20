"""Join of texts by Jaccard similarity of word shingles: chosen paths over sampled tokens.

1. Texts of the same words are one group, joined later through one member.
2. A set is represented by ``SKETCH`` sampled tokens: the least of its shingles under
   each of as many hash functions. Runs split the sets on the token at a sampled place.
3. The first ``THINNING`` runs only compare each set with a few of its bucket, the
   leaders: sets alike in ``BESIDE`` of the places are linked to the leader for now, and
   those alike in ``CLOSE`` need no further run. For by the triangle inequality of the
   Jaccard distance whatever is within 0.2 of such a set is itself near enough to that
   leader to be linked to it when they meet; such a leader never leaves, and meets the
   others at ``BESIDE`` in all later runs. So a group of many near copies passes the
   later runs with few of its members.
4. The other runs split all that stays (on a second place in every fourth run, so that a
   pair at the threshold is expected to stay together once). Buckets of more than
   ``LIMIT`` sets are split again, at places drawn from the bucket's path, up to
   ``DEPTH`` times, after a comparison with leaders of their own, by which sets leave
   that bucket; what is still larger is compared in blocks. Buckets of equal members are
   compared once. Runs are repeated until the target recall: ``runs_for``.
5. In a bucket, sets whose sketches agree in ``LOOSE`` of the places or more are
   linked for now; connected components of these links are candidate classes.
6. In each candidate class all pairs are verified exactly, in blocks, on whole
   shingle sets. Only links with Jaccard at or above the threshold count.

The number of links counts copies: texts of the same words link with each other.

Defined cases: a null, empty or wordless text has no shingles and links with
nothing; a text of fewer words than a shingle has one shingle, all its words; each
row of a repeated doc_id is a document of its own, null ids among them (the class id is
the least doc_id of the class, and the first row of it in storage order is kept); a
null doc_id sorts last; an empty table gives no rows. ``one_of_each`` holds the input in
one struct, so its columns may have any names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import cells, common
from tidewatch.llm.words import Words, mix, words

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9995
SKETCH, LIMIT, DEPTH = 64, 512, 4
LOOSE = 0.6
#: Leaders of a bucket, the shares of equal places from which a set is linked to one, and leaves, and the runs with leaders alone.
LEADERS, BESIDE, CLOSE, THINNING = 4, 0.5, 0.875, 3
#: Chance that a run keeps a pair at the threshold together down to a bucket that is compared.
KEPT = 0.4
#: Shingles in a block of an exact comparison.
BLOCK_TOKENS = 400_000

_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def runs_for(recall: float = RECALL, kept: float = KEPT) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


def places(runs: int) -> list[int]:
    """Sketch places on which sets are split: those of the runs with leaders alone, then those of ``runs`` others."""
    return [k % SKETCH for k in range(THINNING + runs + (runs + 3) // 4)]


def shingles(block: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the rows of a block, and bounds by row."""
    grams, _, bounds = block.grams(k)
    n = np.diff(block.bounds)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return grams, bounds
    counts = np.diff(bounds)
    counts[short] = 1
    at = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(at[-1], np.uint64)
    keep = np.ones(at[-1], bool)
    keep[at[short]] = False
    out[keep] = grams
    for size in range(1, k):
        rows = short[n[short] == size]
        if len(rows):
            some, _, own = block.grams(size)
            out[at[rows]] = some[own[rows]]
    return out, at


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least value of each row under each hash function; rows without shingles are dropped."""
    from_ = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(from_), SKETCH), np.uint64)
    if len(from_):
        for k in range(SKETCH):
            out[:, k] = np.minimum.reduceat((hashes ^ FLIP[k]) * MULTIPLY[k], from_)
    return out


def prints(block: Words) -> list[bytes | None]:
    """Digest of the words of each row; None without words."""
    body = block.hashes.tobytes()
    return [hashlib.md5(body[8 * a : 8 * b], usedforsecurity=False).digest() if b > a else None for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)]


def summarise(split_at: list[int], k: int, text):
    """Arrow function: adds to a batch print, keys (buckets of the runs) and sketch of the texts that ``text(batch)`` gives; drops a column named __text."""

    def run(batches):
        for batch in batches:
            fps, keys, codes = [], [], []
            for block in words(text(batch)):
                fps += prints(block)
                hashes, bounds = shingles(block, k)
                some = np.diff(bounds) > 0
                low = sketches(hashes, bounds)
                key = mix(low[:, split_at] ^ mix(np.arange(len(split_at), dtype=np.uint64) + np.uint64(99))).view(np.int64)
                code = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
                at = iter(range(len(low)))
                for has in some.tolist():
                    row = next(at) if has else None
                    keys.append(key[row] if has else None)
                    codes.append(code[row].tobytes() if has else None)
            rest = batch.drop_columns(["__text"]) if "__text" in batch.schema.names else batch
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary())], [*rest.schema.names, "fp", "keys", "sketch"])

    return common.tidy(run)


MADE = "fp binary, keys array<bigint>, sketch binary"


def sets_of(k: int):
    """Arrow function: (id, fp, text, ...) to id, the others, set (sorted shingle hashes as bytes) and size, once for each id of a task, where the text has the print fp."""

    def run(batches):
        seen = set()
        for batch in batches:
            at, sets, sizes = [], [], []
            ids, fp = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in words(batch.column(2)):
                hashes, bounds = shingles(block, k)
                for row, own in enumerate(prints(block)):
                    r = block.first + row
                    if own == fp[r] and ids[r] not in seen:
                        seen.add(ids[r])
                        some = np.unique(hashes[bounds[row] : bounds[row + 1]])
                        at.append(r)
                        sets.append(some.tobytes())
                        sizes.append(len(some))
            rest = batch.drop_columns([batch.schema.names[1], batch.schema.names[2]]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary()), pa.array(sizes, pa.int64())], [*rest.schema.names, "set", "size"])

    return common.tidy(run)


def alike_sketches(loose: float):
    """Sketches alike in ``loose`` of their places, or in BESIDE where one of them leads sets that have left."""

    def likeness(table: pa.Table) -> np.ndarray:
        codes = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(table), SKETCH)
        out = np.zeros((len(codes), len(codes)), np.uint8)
        for k in range(SKETCH):
            out += codes[:, None, k] == codes[None, :, k]
        leads = np.asarray(table.column("leads"))
        return out >= np.where(leads[:, None] | leads[None, :], least, most)

    def pairs(batch: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        codes = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
        leads = np.asarray(batch.column("leads"))
        same = np.concatenate([(codes[i[k : k + 4096]] == codes[j[k : k + 4096]]).sum(axis=1) for k in range(0, len(i), 4096)])
        return same >= np.where(leads[i] | leads[j], least, most)

    least, most = math.ceil(min(loose, BESIDE) * SKETCH), math.ceil(loose * SKETCH)
    likeness.pairs = pairs
    return likeness


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    n = len(sets)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    use = shared[back]
    owner, at = owner[use], new[back[use]]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += m @ m.T
    return out


def alike_sets(threshold: float):
    def likeness(table: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        both = overlaps(sets)
        return both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9

    return likeness


def beside_leaders(batches):
    """Arrow function: (b, id, sketch, leader ids, leader sketches) to b, id, sketch, the leaders it is linked to, and the one close to it."""
    for batch in batches:
        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, SKETCH)
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        near = np.zeros((LEADERS, len(ids)), bool)
        close = np.full(len(ids), -1)
        own = np.zeros(len(ids), bool)
        lead = np.array(batch.column(3).to_pylist(), np.int64).reshape(-1, LEADERS)
        other = np.frombuffer(b"".join(x for row in batch.column(4).to_pylist() for x in row), np.uint16).reshape(-1, LEADERS, SKETCH)
        for k in range(LEADERS):
            same = (codes == other[:, k]).sum(axis=1)
            near[k] = (same >= BESIDE * SKETCH) & (lead[:, k] != ids)
            own |= lead[:, k] == ids
            close = np.where((close < 0) & (same >= CLOSE * SKETCH), lead[:, k], close)
        close[own] = -1  # a leader stays
        # leaders that a set joins are joined by the first such set of the batch; later ones need one of them, the close one if any
        linked, known = [], set()
        for r in range(len(ids)):
            mine = tuple(lead[r, near[:, r]].tolist())
            linked.append(list(mine) if mine not in known else [int(close[r])] if close[r] >= 0 else list(mine[:1]))
            known.add(mine)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(linked, pa.list_(pa.int64())), pa.array(close, mask=close < 0)], ["b", "id", "sketch", "leaders", "close"])


def led(scratch: common.Scratch, inside: DataFrame, name: str) -> DataFrame:
    """``inside(b, id, sketch)`` compared with LEADERS leaders of each bucket; see ``beside_leaders``."""
    first = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "sketch")).alias(f"l{k}") for k in range(LEADERS)]
    lead = inside.groupBy("b").agg(*first).select("b", F.array(*[f"l{k}.id" for k in range(LEADERS)]).alias("lead"), F.array(*[f"l{k}.sketch" for k in range(LEADERS)]).alias("codes"))
    beside = inside.select("b", "id", "sketch").join(lead, "b").select("b", "id", "sketch", "lead", "codes")
    return scratch.write(beside.mapInArrow(common.tidy(beside_leaders), "b bigint, id bigint, sketch binary, leaders array<bigint>, close bigint"), name)


def edges_to_leaders(beside: DataFrame) -> DataFrame:
    return beside.select(F.col("id").alias("a"), F.explode("leaders").alias("b"))


def thinned(scratch: common.Scratch, nodes: DataFrame, runs: int = THINNING) -> tuple[DataFrame, DataFrame]:
    """What stays of ``nodes(id, keys, sketch)`` for the other runs, with ``leads`` (whether sets left for it), and edges (a, b) to leaders."""
    spark = scratch.spark
    gone, edges = spark.createDataFrame([], "id bigint, close bigint"), spark.createDataFrame([], "a bigint, b bigint")
    for k in range(runs):
        left = nodes.join(common.small(gone.select("id")), "id", "left_anti") if k else nodes
        level = left.select(F.element_at("keys", k + 1).alias("b"), "id", "sketch")
        shared = level.select("b").groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b")
        beside = led(scratch, level.join(shared, "b"), f"led-{k}")
        edges = edges.unionByName(edges_to_leaders(beside))
        stay = common.small(gone.select(F.col("close").alias("id")).distinct())
        new = beside.filter("close is not null").select("id", "close").join(stay, "id", "left_anti")
        gone = gone.unionByName(new)  # a plan over the tables written so far
    leads = common.small(gone.select(F.col("close").alias("id"), F.lit(True).alias("leads")).distinct())
    left = nodes.join(common.small(gone.select("id")), "id", "left_anti").join(leads, "id", "left")
    return left.withColumn("leads", F.coalesce("leads", F.lit(False))), edges


def buckets(scratch: common.Scratch, nodes: DataFrame, limit: int = LIMIT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Members (b, id, n, sketch, leads) of the buckets to compare, from ``nodes(id, keys, sketch, leads)``, n the bucket's size; and edges (a, b) to leaders."""
    level = nodes.select("id", F.explode(F.slice("keys", THINNING + 1, F.size("keys"))).alias("b"))
    out, edges = None, scratch.spark.createDataFrame([], "a bigint, b bigint")
    for d in range(depth + 1):
        sizes = level.groupBy("b").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(5))).alias("y")).filter("n > 1")
        sizes = scratch.write(sizes.groupBy("n", "x", "y").agg(F.min("b").alias("b")).select("b", "n"), f"sizes-{d}")
        inside = level.join(sizes, "b")
        if not d:  # rows of the first level are many and have no sketch; later levels carry it along
            inside = inside.join(nodes.select("id", "sketch", "leads"), "id")
        inside = scratch.write(inside.select("b", "id", "n", "sketch", "leads"), f"inside-{d}")
        got = inside.filter(F.col("n") <= limit) if d < depth else inside
        out = got if out is None else out.unionByName(got)
        large = inside.filter(F.col("n") > limit)
        if d == depth or large.isEmpty():
            break
        beside = led(scratch, large, f"beside-{d}")
        edges = edges.unionByName(edges_to_leaders(beside).distinct())

        def child(salt: int, d: int = d):
            place = F.pmod(F.xxhash64("b", F.lit(d), F.lit(salt)), F.lit(SKETCH)).cast("int")
            return F.xxhash64("b", place, F.substring("sketch", place * 2 + 1, F.lit(2)))

        again = F.pmod(F.xxhash64("b", F.lit(d), F.lit(3)), F.lit(4)) == 0
        stays = beside.filter("close is null").join(common.small(nodes.filter("leads").select("id", "leads")), "id", "left")
        level = stays.select("id", "sketch", F.coalesce("leads", F.lit(False)).alias("leads"), F.explode(F.when(again, F.array(child(1), child(2))).otherwise(F.array(child(1)))).alias("b"))
        level = scratch.write(level.dropDuplicates(["id", "b"]), f"level-{d + 1}")
    return out, edges


def classes(scratch: common.Scratch, rows: DataFrame, texts: DataFrame, threshold: float, shingle: int, loose: float) -> DataFrame:
    """Of ``rows(uid, key, h, fp, keys, sketch)``: (uid, key, class_uid, class_key, n_links); ``texts(key, text)`` has the texts, h is ``raw`` of them."""
    groups = rows.filter("fp is not null").groupBy("fp").agg(F.count("*").alias("copies"), F.min("key").alias("least"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.min(F.struct("uid", "key", "h")).alias("one"))
    groups = scratch.write(groups.select("fp", "copies", "least", "keys", "sketch", F.col("one.uid").alias("id"), "one.key", "one.h"), "groups")
    left, led_by = thinned(scratch, groups.select("id", "keys", "sketch"))
    got, beside = buckets(scratch, scratch.write(left, "left"))
    near = cells.dealt(got, cells.blocks_for(F.col("n"))).drop("n")
    loose_edges = cells.compared(near, alike_sketches(loose)).select("a", "b").unionByName(beside).unionByName(led_by)
    found = scratch.write(common.components(scratch, loose_edges, "loose-parts"), "candidates")
    need = scratch.write(found.join(groups.select("id", "key", "h", "fp", "copies"), "id"), "need")
    # a text is found by its row's key and hash, so rows that share a null or other key aren't paired with each other
    held = common.small(need.select("id", "fp", "root", "copies", "key", "h")).alias("n")
    text = texts.select(F.col("key").alias("k"), "text").join(held, F.col("k").eqNullSafe(F.col("n.key")) & (raw(F.col("text")) == F.col("n.h")))
    text = text.select("id", "fp", "text", F.col("root").alias("b"), "copies")
    sets = scratch.write(text.mapInArrow(sets_of(shingle), "id bigint, b bigint, copies bigint, set binary, size bigint"), "sets")
    if sets.count() > need.count():  # rows that repeat key and text gave a set in more than one task
        sets = scratch.write(sets.dropDuplicates(["id"]), "sets-once")
    extent = sets.groupBy("b").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    extent = extent.filter("n > 1").select("b", F.greatest(cells.blocks_for(F.col("n")), cells.blocks_for(F.col("tokens"), BLOCK_TOKENS)).alias("nb"))
    exact = cells.dealt(sets.join(extent, "b"), F.col("nb")).drop("nb", "size")
    judged = scratch.write(cells.compared(exact, alike_sets(threshold), "copies"), "judged")
    scratch.drop("sets")
    links = judged.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    parts = scratch.write(common.components(scratch, judged.filter("b is not null").select("a", "b"), "parts"), "classes")
    whole = groups.select("id", "fp", "copies", "least").join(parts, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = scratch.write(whole.select("fp", "root", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "whole")
    least = whole.groupBy("root").agg(F.min("least").alias("class_key"))
    named = whole.join(least, "root").select("fp", "root", "class_key", "n_links")
    out = rows.select("uid", "key", "fp").join(named, "fp", "left")
    return out.select("uid", "key", F.coalesce("root", "uid").alias("class_uid"), F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("class_key")).alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def raw(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join(scratch: common.Scratch, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, loose: float = LOOSE) -> DataFrame:
    """Of ``docs(key, text)``: one row per row with uid, key, class_uid, class_key (least key of the class) and n_links."""
    kind = docs.schema["key"].dataType.simpleString()
    rows = docs.select("key", raw(F.col("text")).alias("h"), F.col("text").alias("__text")).mapInArrow(summarise(places(runs_for(recall)), shingle, lambda batch: batch.column(2)), f"key {kind}, h bigint, {MADE}")
    rows = scratch.write(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    return classes(scratch, rows, docs, threshold, shingle, loose)


def one_of_each(scratch: common.Scratch, docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each class: the first of those with the class's least key."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), raw(F.col("text")).alias("h"))
    at = docs.columns.index("text")
    kinds = f"row {held.schema['row'].dataType.simpleString()}, key {held.schema['key'].dataType.simpleString()}, h bigint, {MADE}"
    rows = held.mapInArrow(summarise(places(runs_for()), shingle, lambda batch: batch.column(0).field(at)), kinds)
    rows = scratch.write(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    named = scratch.write(classes(scratch, rows.drop("row"), docs.select(F.col(key).alias("key"), "text"), threshold, shingle, LOOSE), "named")
    first = named.groupBy("class_uid").agg(F.min(F.struct(F.col("key").isNull(), "key", "uid"))["uid"].alias("uid"))
    gone = scratch.write(named.select("uid").join(first, "uid", "left_anti"), "gone")
    return rows.join(common.small(gone), "uid", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    out = join(common.Scratch(spark, "ngram-join"), docs)
    return out.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"), "n_links", F.coalesce(F.col("key") == F.col("class_key"), F.lit(False)).alias("kept"))


#: All pairs that share a shingle, and what each text reaches by links.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT rid, unnest(list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' ')))) AS s FROM d WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.rid < y.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, other) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a),
k AS (SELECT a AS rid, count(*) AS n_links FROM e GROUP BY a),
c AS (SELECT id AS rid, min(doc_id) AS least FROM reach JOIN d ON d.rid = other GROUP BY id)
SELECT doc_id, CASE WHEN c.rid IS NULL THEN doc_id ELSE least(doc_id, c.least) END AS class_id, coalesce(n_links, 0) AS n_links,
       coalesce(doc_id = CASE WHEN c.rid IS NULL THEN doc_id ELSE least(doc_id, c.least) END, false) AS kept
FROM d LEFT JOIN k USING (rid) LEFT JOIN c USING (rid)
"""
