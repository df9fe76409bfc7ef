"""Exact top-k search by multi-resolution segment statistics.

A vector cut into segments has a mean and a deviation for each. For vectors x, y and segments of length l,
sum of l * ((mean x - mean y)^2 + (dev x - dev y)^2) never exceeds their squared distance, and finer segments bound it more
closely. The search goes coarse to fine: blocks of vectors whose statistics lie too far from every query of a block are not
sent to it; inside a pair of blocks each level drops pairs of a query and a vector that can't be among the k nearest, the
bounds of the finest level choose the k vectors that are compared first, and the survivors get exact distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import packed as P
from . import text as X
from .vectors import matrix, usable

_SLACK = 1e-6
#: Share of the pairs of a query tile and a block from which exact distances are one matrix product, masked by the survivors.
_PRODUCT = 0.02


def levels(d: int) -> list[int]:
    """Numbers of segments, coarse to fine, at most a quarter of the dimensions."""
    out, n = [], 2
    while n <= max(2, d // 4):
        out.append(min(n, d))
        n *= 2
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length: Euclidean distances of these
    rows are lower bounds of those of x."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(np.int64)
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            s = x[:, lo:hi]
            out += [s.mean(1) * np.sqrt(hi - lo), s.std(1) * np.sqrt(hi - lo)]
    return np.column_stack(out)


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T))


class _Best:
    """The k nearest so far of each query, ordered by distance and then id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.dist = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.stats = [statistics(x, s) for s in levels(x.shape[1])]
        self.compared = 0

    def bound(self, q: np.ndarray) -> np.ndarray:
        return self.dist[q, -1] ** 2 * (1 + _SLACK) + _SLACK

    def meet(self, ids: np.ndarray, y: np.ndarray, step: int = 512) -> None:
        stats = [statistics(y, s) for s in levels(y.shape[1])]
        for lo in range(0, len(self.ids), step):
            q = np.arange(lo, min(lo + step, len(self.ids)))
            ok = self.ids[q][:, None] != ids[None, :]
            for mine, theirs in zip(self.stats, stats):
                gap = _sq(mine[q], theirs)
                ok &= gap <= self.bound(q)[:, None]
                if not ok.any():
                    break
            if not ok.any():
                continue
            first = np.zeros_like(ok)
            if len(ids) > 4 * self.k:  # the nearest by bound come first and tighten the bound for the others
                near = np.argpartition(np.where(ok, gap, np.inf), self.k - 1, axis=1)[:, : self.k]
                np.put_along_axis(first, near, True, 1)
                first &= ok
                self._compare(q, ids, y, first)
                ok &= ~first & (gap <= self.bound(q)[:, None])
            self._compare(q, ids, y, ok)

    def _compare(self, q: np.ndarray, ids: np.ndarray, y: np.ndarray, ok: np.ndarray) -> None:
        """Takes the exact distances of the pairs in ok, and keeps the k nearest."""
        if ok.mean() > _PRODUCT:
            rough = np.where(ok, _sq(self.x[q], y), np.inf)
            limit = self.bound(q)
            if len(ids) > self.k:
                limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] * (1 + _SLACK) + _SLACK)
            ok = ok & (rough <= limit[:, None])
        r, col = np.nonzero(ok)
        if not len(r):
            return
        self.compared += len(r)
        exact = np.sqrt(((self.x[q[r]] - y[col]) ** 2).sum(1))
        row = np.concatenate([np.repeat(np.arange(len(q)), self.k), r])
        dist, who = np.concatenate([self.dist[q].ravel(), exact]), np.concatenate([self.who[q].ravel(), ids[col]])
        order = np.lexsort((who, dist, row))
        row, dist, who = row[order], dist[order], who[order]
        at = np.searchsorted(row, np.arange(len(q)))[:, None] + np.arange(self.k)
        self.dist[q], self.who[q] = dist[at], who[at]

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(self.dist < np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array((c + 1).astype(np.int32)), pa.array(self.who[r, c]), pa.array(np.round(self.dist[r, c], 6))], ["vec_id", "rank", "neighbour", "distance"])


def _pack(ids: np.ndarray, x: np.ndarray) -> bytes:
    return ids.astype("<i8").tobytes() + x.astype("<f4").tobytes()


def _unpack(blob: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // (8 + 4 * d)
    return np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<f4", n * d, 8 * n).reshape(n, d).astype(np.float64)


def _blocks(rows: DataFrame, d: int, size: int, solve, schema: str, name: str) -> DataFrame:
    """rows (vec_id, v) range-sorted by their coarse statistics into blocks of about size, written; each block is numbered by
    its partition and place there, and solve(ids, vectors) gives its other columns."""
    half = max(1, d // 2)
    mean = [F.round(F.aggregate(F.slice("v", lo, n), F.lit(0.0), lambda a, x: a + x) / n, 2) for lo, n in ((1, half), (half + 1, d - half)) if n]

    def pack(batches):
        ids, xs = [], []
        for b in batches:
            if b.num_rows:
                ids.append(np.asarray(b.column(0)))
                xs.append(matrix(b.column(1), d))
        if not ids:
            return
        ids, x, part = np.concatenate(ids), np.concatenate(xs), TaskContext.get().partitionId()
        for n, lo in enumerate(range(0, len(ids), size)):
            i, y = ids[lo : lo + size], x[lo : lo + size].astype(np.float64)
            yield pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + n], pa.int64()), "blob": pa.array([_pack(i, y)], pa.binary()), **solve(i, y)})

    ranged = rows.repartitionByRange(max(1, -(-rows.count() // size)), *mean, "vec_id")
    return cut(ranged.mapInArrow(X.lean(pack), f"block long, blob binary, {schema}"), name)


#: Blocks whose ranges of statistics are one row of the plan.
_GROUP = 256


def nearest(table: DataFrame, k: int = 10, every: int = 1, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """(vec_id, rank, neighbour, distance): the k nearest vectors of every vector whose id is divisible by every, among all
    vectors, by Euclidean distance (to six digits) and then by id; a row's own id is no neighbour of it.

    Rows that usable leaves out (null ids, null, empty or odd vectors) neither search nor are found. A row that occurs
    twice searches twice and is found twice. Fewer than k other rows give fewer neighbours. Other columns are ignored.
    Vectors and queries are each range-sorted by their coarse statistics into blocks. A query's search starts among the
    queries of its block, which bounds how far its neighbours can be; only the blocks of vectors within some query's bound
    are sent to a block of queries, nearest first, and a task holds one block of either at a time.
    """
    rows, d = usable(table)
    if not d:
        return table.sparkSession.createDataFrame([], "vec_id long, rank int, neighbour long, distance double")
    sizes = levels(d)

    def ranges(ids, y):
        s = np.concatenate([statistics(y, n) for n in sizes], axis=1)
        return {"low": pa.array([s.min(0).tobytes()], pa.binary()), "high": pa.array([s.max(0).tobytes()], pa.binary())}

    def reach(ids, y):
        own = _Best(ids, y, k)
        own.meet(ids, y)
        return {"reach": pa.array([own.dist[:, -1].tobytes()], pa.binary())}

    vectors = _blocks(rows, d, block_rows, ranges, "low binary, high binary", "vector-blocks")
    asked = _blocks(rows.filter(F.col("vec_id") % every == 0), d, query_rows, reach, "reach binary", "query-blocks")

    def group(batches):
        held: list[tuple] = []
        for b in batches:
            held += zip(*(b.column(i).to_pylist() for i in range(3)))
            while len(held) >= _GROUP:
                yield _joined(held[:_GROUP])
                held = held[_GROUP:]
        if held:
            yield _joined(held)

    def _joined(rows):
        name, low, high = zip(*rows)
        return pa.RecordBatch.from_pydict({"blob": pa.array([P.pack(np.array(name, "<i8"), b"".join(low), b"".join(high))], pa.binary())})

    n_groups = max(1, -(-vectors.count() // _GROUP))
    groups = vectors.select("block", "low", "high").repartition(n_groups).mapInArrow(group, "blob binary")
    groups = cut(groups.select(F.monotonically_increasing_id().alias("g"), "blob"), "vector-groups")
    names = [r["g"] for r in groups.select("g").collect()]  # one number for each _GROUP * block_rows vectors

    def plan(batches):
        """Query blocks with groups -> the vector blocks that some query of the block may need, with the least gap."""
        for b in batches:
            for query, blob, far, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                ids, x = _unpack(blob.as_buffer(), d)
                bound = np.frombuffer(far.as_buffer(), "<f8") ** 2 * (1 + _SLACK) + _SLACK
                stats = [statistics(x, n) for n in sizes]
                name, low, high = P.unpack(ranges.as_buffer(), "<i8", "<f8", "<f8")
                low, high = low.reshape(len(name), -1), high.reshape(len(name), -1)
                out = []
                for v in range(len(name)):
                    left, lo, gap = np.arange(len(ids)), 0, np.zeros(len(ids))
                    for s in stats:
                        span = slice(lo, lo + s.shape[1])
                        lo += s.shape[1]
                        off = np.maximum(0, np.maximum(low[v, span] - s[left], s[left] - high[v, span]))
                        gap = (off * off).sum(1)
                        near = gap <= bound[left]
                        left, gap = left[near], gap[near]
                        if not len(left):
                            break
                    if len(left):
                        out.append((query, int(name[v]), float(gap.min())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query", "block", "gap"])

    spread = asked.select(F.col("block").alias("query"), F.col("blob").alias("asked"), "reach", F.explode(F.array(*[F.lit(g) for g in names]) if names else F.array().cast("array<long>")).alias("g"))
    meets = spread.join(groups, "g").select("query", "asked", "reach", "blob").mapInArrow(X.lean(plan), "query long, block long, gap double")
    own = asked.select(F.col("block").alias("query"), F.lit(-1.0).alias("gap"), F.lit(-1).cast("long").alias("block"), "blob")
    sent = meets.join(vectors.select("block", "blob"), "block").select("query", "gap", "block", "blob").unionByName(own)

    def search(batches):
        query, best = None, None
        for b in batches:
            for name, block, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                ids, x = _unpack(blob.as_buffer(), d)
                if name != query:
                    if best is not None:
                        yield best.rows()
                    query, best = name, _Best(ids, x, k)
                else:
                    best.meet(ids, x)
        if best is not None:
            yield best.rows()

    n_queries = max(1, asked.count())
    return sent.repartition(min(n_queries, 100_000), "query").sortWithinPartitions("query", "gap", "block").mapInArrow(X.lean(search), "vec_id long, rank int, neighbour long, distance double")
