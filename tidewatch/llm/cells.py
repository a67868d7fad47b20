"""All pairs within groups, in blocks: a group of any size becomes cells of at most two blocks.

Members of a group are dealt to blocks by a hash of their id; a cell holds one
block, or two different ones of which only pairs across count. So every pair of a
group meets in exactly one cell, a cell's size is bounded, and what a cell returns
(edges of a spanning forest and counts) grows with its members, not its pairs.
Cells of few rows, which are by far the most, are compared many at a time, pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

BLOCK = 256
#: Rows of a cell that is compared with others of its batch at a time.
FEW = 16


def dealt(members: DataFrame, n_blocks: Column) -> DataFrame:
    """``members(b, id, ...)`` once for each cell of its group: adds ci, cj and side (1: second block of a cell of two)."""
    own = F.pmod(F.xxhash64("id", F.lit(17)), n_blocks).cast("int")
    out = members.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
    return out.withColumns({"ci": F.least("__own", "__other"), "cj": F.greatest("__own", "__other"), "side": (F.col("__own") > F.col("__other")).cast("int")}).drop("__own", "__other")


def blocks_for(n: Column, size: int = BLOCK) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("long")


def runs(batches, few: int = 0) -> Iterator[pa.Table | tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Tables of the rows of one cell each, from batches sorted by (b, ci, cj), the first columns.

    Cells of one block with at most ``few`` rows that lie within a batch come together, as the batch, their first rows and their sizes.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        at = np.concatenate(([0], np.flatnonzero(change), [batch.num_rows]))
        size = np.diff(at)
        together = (size <= few) & (keys[1][at[:-1]] == keys[2][at[:-1]])
        together[[0, -1]] = False  # may go on in another batch
        some = together & (size > 1)
        if some.any():
            yield batch, at[:-1][some], size[some]
        for k in np.flatnonzero(~together).tolist():
            a, b = int(at[k]), int(at[k + 1])
            key = (keys[0][a], keys[1][a], keys[2][a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def pairs_within(firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both rows of every pair of rows of one cell."""
    left, right = [], []
    for size in np.unique(sizes).tolist():
        i, j = np.triu_indices(size, 1)
        at = firsts[sizes == size][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each of n things the least one that a symmetric n x n relation reaches from it."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def relation(table: pa.Table, likeness: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of a cell, their row numbers, and which pairs count and are alike (symmetric)."""
    ids, rows = np.unique(table.column("id").to_numpy(), return_index=True)
    side = table.column("side").to_numpy()[rows]
    two = len(np.unique(np.asarray([table.column("ci")[0].as_py(), table.column("cj")[0].as_py()]))) == 2
    linked = likeness(table.take(pa.array(rows)))
    linked &= (side[:, None] != side[None, :]) if two else ~np.eye(len(ids), dtype=bool)
    return ids, rows, linked


OUT = "a bigint, b bigint, n bigint"


def compared(rows: DataFrame, likeness: Callable, weight: str | None = None) -> DataFrame:
    """Edges (a, b, null) of a spanning forest of each cell and, with ``weight``, sums (a, null, n) of the weights of a's partners.

    ``likeness`` takes the rows of a cell and returns a Boolean matrix; if it has ``pairs``,
    that takes a batch and both rows of pairs and returns which are alike. ``rows`` has
    columns b, ci, cj, side, id and what ``likeness`` and ``weight`` name.
    """
    by_pair = getattr(likeness, "pairs", None)

    def run(batches):
        a, b, n = [], [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else np.zeros(0, np.int64)), pa.array(np.concatenate(b) if b else np.zeros(0, np.int64), mask=None if not b else np.concatenate(b) < 0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), mask=None if not n else np.concatenate(n) < 0)], ["a", "b", "n"])

        for table in runs(batches, FEW if by_pair else 0):
            if isinstance(table, tuple):
                batch, firsts, sizes = table
                i, j = pairs_within(firsts, sizes)
                ids = batch.column("id").to_numpy()
                met = by_pair(batch, i, j) & (ids[i] != ids[j])
                i, j = i[met], j[met]
                a.append(np.maximum(ids[i], ids[j]))
                b.append(np.minimum(ids[i], ids[j]))
                n.append(np.full(len(i), -1))
                if weight:
                    w = batch.column(weight).to_numpy().astype(np.int64)
                    a += [ids[i], ids[j]]
                    b.append(np.full(2 * len(i), -1))
                    n += [w[j], w[i]]
                if sum(map(len, a)) > 50_000:
                    yield out()
                    a, b, n = [], [], []
                continue
            if len(table) < 2:
                continue
            ids, at, linked = relation(table, likeness)
            label = forest(linked)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            if len(moved):
                a.append(ids[moved])
                b.append(ids[label[moved]])
                n.append(np.full(len(moved), -1))
            if weight and len(moved):
                own = linked @ table.column(weight).to_numpy()[at].astype(np.int64)
                some = np.flatnonzero(own)
                a.append(ids[some])
                b.append(np.full(len(some), -1))
                n.append(own[some])
            if sum(map(len, a)) > 50_000:
                yield out()
                a, b, n = [], [], []
        yield out()

    first = ["b", "ci", "cj"]
    placed = rows.select(*first, *[c for c in rows.columns if c not in first])
    placed = placed.repartition(*first).sortWithinPartitions(*first)
    return placed.mapInArrow(common.tidy(run), OUT)
