"""Vectorised work on Arrow text columns: slicing by bytes, words, 64-bit hashes of words and word windows."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a Python worker; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows handled at once, so that a text's number within its slice has 16 bits.
SLICE_ROWS = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII white space ends a word; every other byte, also of a multi-byte character, belongs to one.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def release() -> None:
    """Gives freed memory back to the system, the table of powers too."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c"))
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, with release at its end: idle Python workers stay with their executor."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()  # by its name: what a nested function itself refers to is sent along with it

    return wrapped


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser: spreads 64-bit values; another seed gives an independent order."""
    h = h ^ np.uint64((seed * _BASE + seed) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = arr.type in (pa.large_string(), pa.large_binary())
    _, offs, data = arr.buffers()
    if offs is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of at most limit bytes of text or one row, and of at most SLICE_ROWS rows."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = buffers(b.column(column))
        lo = 0
        while lo < b.num_rows:
            hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1), lo + SLICE_ROWS)
            yield b.slice(lo, hi - lo)
            lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; span_hash cuts spans out of it."""
    p, _ = _pow(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, q = _pow(len(run))
    return mix((run[end] - run[start]) * q[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and where each text's words start in those arrays."""
    n = len(data)
    inside = np.empty(n + 1, bool)
    inside[:n] = ~SPACE[data]
    inside[n] = False
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    edge = off[(off > 0) & (off < n)]
    first[edge] = inside[edge]
    last = inside[:n] & ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def windows(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n consecutive words inside a text; the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
    ok = np.ones(len(out), bool)
    for b in range(1, n):
        cut = bounds[1:-1] - b
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words in O(1) a word, without regard to text ends."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p, q = _pow(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=run[1:])
    return mix((run[n:] - run[:-n]) * q[: len(h) - n + 1])
