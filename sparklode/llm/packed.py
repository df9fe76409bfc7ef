"""Packed shuffles: Python workers exchange numpy arrays as binary rows, each addressed to a partition by its number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as X

SCHEMA = "bucket int, kind int, blob binary"
#: Low bits of a hash that are kept as a token: six bytes.
TOKEN = np.uint64((1 << 48) - 1)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def six(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(raw) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :6] = b
    return out.view("<u8").ravel()


def pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unpack(blob, *kinds: str | None) -> list:
    """The arrays of a packed blob; kinds: numpy types, or None for raw bytes."""
    view = memoryview(blob)
    n = int(np.frombuffer(view[:8], "<i8")[0])
    sizes = np.frombuffer(view[8 : 8 + 8 * n], "<i8")
    at, out = 8 + 8 * n, []
    for kind, size in zip(kinds, sizes):
        part = view[at : at + size]
        out.append(part if kind is None else np.frombuffer(part, kind))
        at += size
    return out


def groups(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that occurs, the positions of its entries in their order."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n)) if n <= 1 << 20 else None
    if ends is None:
        b = bucket[order]
        cut = np.flatnonzero(np.diff(b, prepend=-1))
        for lo, hi in zip(cut, np.append(cut[1:], len(b))):
            yield int(b[lo]), order[lo:hi]
        return
    lo = 0
    for k in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(k), order[lo : ends[k]]
        lo = ends[k]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(values)))


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])


def emit(rows: Iterator[tuple[int, int, bytes]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 24
        if size > limit:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def exchange(df: DataFrame, n: int, reduce: Callable[[dict[int, list]], Iterator], schema: str = SCHEMA) -> DataFrame:
    """Sends each row to the partition of its bucket; reduce gets a partition's blobs by kind and yields record batches."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            kinds = b.column(1).to_pylist()
            for i, kind in enumerate(kinds):
                held.setdefault(kind, []).append(b.column(2)[i].as_buffer())
        if held:
            yield from reduce(held)

    return df.repartitionById(n, "bucket").mapInArrow(X.lean(run), schema)
