"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import text as X


def _forest(batches):
    """Edges of a spanning forest of the edges that a task sees; the others add nothing."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        keep = []
        for i, (u, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            ru, rv = find(u), find(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
                keep.append(i)
        if keep:
            yield b.take(pa.array(np.array(keep, np.int64)))


#: Edges of all tasks' forests up to which one task joins them; beyond it labels spread in rounds.
ONE_TASK = 1_000_000


def _roots(batches):
    """(node, root) of the edges of one task, without regard to their order."""
    u, v = [], []
    for b in batches:
        u.append(np.asarray(b.column(0)))
        v.append(np.asarray(b.column(1)))
    if not u:
        return
    node, end = np.unique(np.concatenate([*u, *v]), return_inverse=True)
    a, b = np.split(end, 2)
    root = np.arange(len(node))
    while True:
        least = np.minimum(root[a], root[b])
        if (least == root[a]).all() and (least == root[b]).all():
            break
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), both long: root is the least node of its component.

    An edge with a null end is none. Tasks thin out their edges to forests. If those are few, one task joins them; else
    labels spread to neighbours and jump to their own label's label until none changes. Each round is written to the
    shared folder, so a lost executor costs that round only.
    """
    thin = cut(edges.filter("u != v").mapInArrow(X.lean(_forest), "u long, v long"), "forest")
    if thin.count() <= ONE_TASK:
        return cut(thin.coalesce(1).mapInArrow(X.lean(_roots), "node long, root long"), "labels")
    both = cut(thin.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(seen, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump, "root", "left").select("node", "old", F.least("root", "far").alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.filter("root != old").limit(1).count():
            return labels
