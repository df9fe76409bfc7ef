"""Embedding near-dedup by lattice hashing.

Each table projects a unit vector on a few random 8-dimensional subspaces, decodes each projection to its nearest point of
the E8 lattice, and hashes the points together into a cell. Vectors meet if one's cell is the other's, or a neighbour of
it: the same cell with one block moved to an adjacent lattice point, the nearest ones first. Who meets is verified by the
exact cosine where they meet: a cell's vectors are sent to one task, those of a large cell by pairs of parts, and a pair
that meets in several cells counts in one of them. No pair is written; a cell returns each vector's number of links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import packed as P
from . import text as X
from .blocks import by_block, classes, forest
from .vectors import matrix, usable


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


SHORTEST = _shortest()


def _d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    k = np.abs(e[odd]).argmax(1)
    r[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by one half in each coordinate, to each row."""
    p, q = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - p) ** 2).sum(1) <= ((x - q) ** 2).sum(1))[:, None], p, q)


def neighbours(x: np.ndarray, p: np.ndarray, n: int) -> list[np.ndarray]:
    """The n lattice points adjacent to p that are nearest to x."""
    gain = (x - p) @ SHORTEST.T
    best = np.argsort(-gain, axis=1, kind="stable")[:, :n]
    return [p + SHORTEST[best[:, k]] for k in range(n)]


def _hash(p: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(p), seed, np.uint64)
    for k in range(8):
        h = X.mix(h ^ np.rint(p[:, k] * 2).astype(np.int64).view(np.uint64), 1)
    return h


def cells(u: np.ndarray, tables: int, blocks: int, scale: float, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys of unit vectors: own cells (rows x tables) and neighbouring ones (rows x tables * blocks * probes)."""
    rng = np.random.default_rng(seed)
    own, near = [], []
    for t in range(tables):
        mine, moved = [], []
        for b in range(blocks):
            w = np.linalg.qr(rng.normal(size=(max(8, u.shape[1]), 8)))[0][: u.shape[1]]
            x = u @ w * scale
            p = decode(x)
            mine.append(_hash(p, t * blocks + b))
            moved.append([_hash(q, t * blocks + b) for q in neighbours(x, p, probes)])
        whole = X.mix(sum(mine, np.uint64(0)))
        own.append(whole)
        for b in range(blocks):
            rest = sum((m for k, m in enumerate(mine) if k != b), np.uint64(0))
            near += [X.mix(rest + q) for q in moved[b]]
    return np.column_stack(own), np.column_stack(near) if near else np.zeros((len(u), 0), np.uint64)


#: Vectors of a cell that are compared in one task; larger cells are split into parts of half as many on average.
PART = 1024


def _meetings(own: np.ndarray, near: np.ndarray | None, a: np.ndarray, b: np.ndarray, per: int) -> np.ndarray:
    """The cell in which a pair counts: the least of the cells that are both vectors' own; for a pair without one (or 0, if
    near isn't given), the least of one's own that are the other's neighbours. per: neighbours of a table."""
    last = np.iinfo(np.int64).max
    out = np.where(own[a] == own[b], own[a], last).min(1)
    if near is not None:
        lone = np.flatnonzero(out == last)
        for lo in range(0, len(lone), 50_000):
            i, j = a[lone[lo : lo + 50_000]], b[lone[lo : lo + 50_000]]
            sides = [np.where(near[x].reshape(len(x), -1, per) == own[y][:, :, None], own[y][:, :, None], last).min((1, 2)) for x, y in ((i, j), (j, i))]
            out[lone[lo : lo + 50_000]] = np.minimum(*sides)
    return out


def links(table: DataFrame, threshold: float = 0.95, tables: int = 8, blocks: int = 2, scale: float | None = None, probes: int = 2, seed: int = 3) -> DataFrame:
    """(vec_id, class_id, n_links), one row for each vec_id: links are to the other ids whose vectors have at least that
    cosine with its own; class_id is the least vec_id that links lead to.

    scale stretches the projections to the lattice; if it isn't given, it follows the dimension, 4 at 64, since a projection
    on 8 of d dimensions shortens distances by the root of 8 / d.

    Approximate in what it finds, exact in what it counts; every row is looked up, and no cell is cut short. Equal vectors
    are one, with copies. An id with a null, empty or zero vector, one of another than the most frequent length, or one with
    null or infinite elements has no link and is a class by itself. Repeated rows count once; an id with several vectors gets
    the least class and the sum of the links of them. Null ids have one row without class and without links. Other columns
    are ignored. An empty table gives no rows.
    """
    every = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(None).cast("long").alias("node"))
    rows, d = usable(table)
    if not d:
        return every.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")).distinct()
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    buckets, per = P.partitions(table), blocks * probes
    scale = 4.0 * np.sqrt(max(8, d) / 64) if scale is None else scale
    entries = cut(rows.select("vec_id", F.xxhash64("v").alias("node")).unionByName(every).distinct(), "entries")
    vectors = rows.select(F.xxhash64("v").alias("node"), "vec_id", "v").groupBy("node").agg(F.countDistinct("vec_id").alias("copies"), F.min("vec_id").alias("least"), F.min("v").alias("v"))

    def hashed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column(3), d).astype(np.float64)
            both = cells(m / np.linalg.norm(m, axis=1, keepdims=True), tables, blocks, scale, probes, seed)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(k).view(np.int64).ravel()), k.shape[1]).cast(pa.list_(pa.int64())) for k in both if k.shape[1]]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], ["node", "copies", "least", "v", "own", "near"][: 4 + len(lists)])

    known = cut(vectors.mapInArrow(X.lean(hashed), "node long, copies long, least long, v array<float>, own array<long>" + ", near array<long>" * (per > 0)), "vectors")
    placed = known.select("node", F.explode("own").alias("cell"), F.lit(True).alias("at_home"))
    if per:
        placed = placed.unionByName(known.select("node", F.explode("near").alias("cell"), F.lit(False).alias("at_home")))
    shared = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bool_or("at_home").alias("home")).filter("n > 1 AND home")
    parts = F.when(F.col("n") <= PART, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / (PART // 2))))).cast("int")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    held = placed.join(shared, "cell").withColumn("parts", parts).withColumn("part", part)
    held = held.select("cell", "node", "at_home", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    block = F.xxhash64("cell", F.least("part", "with"), F.greatest("part", "with"))
    members = held.join(known.select("node", "copies", "v", "own"), "node")
    members = members.select(block.alias("block"), F.lit(0).alias("kind"), "node", "copies", "v", "own", "cell", "at_home", "part", "with")

    def solve(m: pa.RecordBatch, _) -> pa.RecordBatch | None:
        node, home = np.asarray(m.column(2)), m.column(7).to_numpy(False)
        order = np.lexsort((~home, node))
        order = order[np.append(True, np.diff(node[order]) != 0)]
        node, home, copies, part = node[order], home[order], np.asarray(m.column(3))[order], np.asarray(m.column(8))[order]
        x = matrix(m.column(4), d).astype(np.float64)[order]
        own = np.asarray(m.column(5).flatten()).reshape(-1, tables)[order]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        a, b = [], []
        for lo in range(0, len(u), 1024):
            i, j = np.nonzero(u[lo : lo + 1024] @ u.T >= threshold - 1e-9)
            i += lo
            ok = (i < j) & (home[i] | home[j])
            a.append(i[ok])
            b.append(j[ok])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(np.unique(part)) > 1:
            ok = part[a] != part[b]
            a, b = a[ok], b[ok]
        ok = (x[a] * x[b]).sum(1) / np.sqrt((x[a] * x[a]).sum(1) * (x[b] * x[b]).sum(1)) >= threshold
        a, b = a[ok], b[ok]
        if len(a):
            cell = m.column(6)[0].as_py()
            at = _meetings(own, None, a, b, per)
            lone = at == np.iinfo(np.int64).max
            if lone.any():
                some, back = np.unique(np.concatenate([a[lone], b[lone]]), return_inverse=True)
                mine, near = (k.view(np.int64) for k in cells(u[some], tables, blocks, scale, probes, seed))
                at[lone] = _meetings(mine, near, *np.split(back, 2), per)
            a, b = a[at == cell], b[at == cell]
        return forest(node, copies, a, b)

    return classes(entries, known.select("node", "copies", "least"), by_block(members, buckets, solve), "node", "vec_id")
