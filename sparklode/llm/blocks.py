"""Verification of candidate pairs in blocks, and the classes that their links make; shared by the near-duplicate joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import packed as P
from . import text as X
from .components import components

LINKS = "u long, v long, n long"
#: Rows of classes up to which they are broadcast to the documents; beyond it both are shuffled.
BROADCAST_ROWS = 1_000_000


def forest(name: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Links between members a and b as LINKS: (member, null, linked rows) of each that has one, a link to a member being
    one to each of its copies, and (member, root, 0) of a spanning forest."""
    if not len(a):
        return None
    n = np.bincount(a, copies[b], len(name)) + np.bincount(b, copies[a], len(name))
    root = np.arange(len(name))
    while True:
        least = np.minimum(root[a], root[b])
        if (least == root[a]).all() and (least == root[b]).all():
            break
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
    some, leaf = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(name)))
    v = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(name[root[leaf]])])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([name[some], name[leaf]])), v, pa.array(np.concatenate([np.rint(n[some]), np.zeros(len(leaf))]).astype(np.int64))], ["u", "v", "n"])


def by_block(rows: DataFrame, buckets: int, solve: Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """solve(members, pairs) of each block as LINKS, written. rows: block and kind (0 members, 1 pairs), then whatever solve
    reads; a task holds one block at a time."""

    def each(parts: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        block, kind = np.asarray(whole.column(0)), np.asarray(whole.column(1))
        start, size = P.runs(block)
        for lo, n in zip(start, size):
            m = int((kind[lo : lo + n] == 0).sum())
            got = solve(whole.slice(lo, m), whole.slice(lo + m, n - m))
            if got is not None:
                yield got

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            block = np.asarray(b.column(0))
            start, _ = P.runs(block)
            if held and held[-1].column(0)[-1].as_py() != block[0]:
                yield from each(held)
                held = []
            last = int(start[-1])
            if last:
                yield from each([*held, b.slice(0, last)])
                held = []
            held.append(b.slice(last))
        if held:
            yield from each(held)

    return cut(rows.repartition(buckets, "block").sortWithinPartitions("block", "kind").mapInArrow(X.lean(run), LINKS), "links")


def classes(entries: DataFrame, copies: DataFrame, found: DataFrame, node: str, row: str) -> DataFrame:
    """(row, class_id, n_links) of each distinct row. entries: distinct (row, node), node null where it has none; copies:
    (node, copies, least), least being the least row of the node; found: LINKS between nodes."""
    near = found.filter("v IS NULL").groupBy(F.col("u").alias(node)).agg(F.sum("n").alias("linked"))
    rooted = components(found.filter("v IS NOT NULL").select("u", "v")).select(F.col("node").alias(node), "root")
    near = cut(near.join(rooted, node).join(copies, node), "near")
    least = near.groupBy("root").agg(F.min("least").alias("class_id"))
    several = near.join(least, "root").select(node, "class_id", (F.col("linked") + F.col("copies") - 1).alias("n"))
    alone = copies.filter("copies > 1").join(near.select(node), node, "left_anti").select(node, F.col("least").alias("class_id"), (F.col("copies") - 1).alias("n"))
    known = cut(several.unionByName(alone), "classes")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    out = entries.filter(F.col(row).isNotNull()).join(known, node, "left").groupBy(row).agg(F.min(F.coalesce("class_id", row)).alias("class_id"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_links"))
    none = entries.filter(F.col(row).isNull()).select(row).distinct().select(row, F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none)
