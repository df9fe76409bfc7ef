"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are trained on binned features with logistic loss and flattened into arrays; prediction walks all rows through all
trees of a slice at once, one level at a time, in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

FEATURES = (
    "log_bytes log_words mean_word share_upper share_digit share_high share_newline share_bang share_pipe share_percent "
    "share_symbol share_comma_stop distinct_words top_word doubled_words distinct_pairs mean_line repeated_lines upper_words long_words"
).split()


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[[ord(c) for c in chars]] = True
    return m


_UPPER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_HIGH = np.arange(256) >= 128
_SYMBOL = _mask("#$&*@^~_=+<>/\\[]{}`")
_CLASSES = (_UPPER, _DIGIT, _HIGH, _mask("\n"), _mask("!"), _mask("|"), _mask("%"), _SYMBOL, _mask(",."))
_WEIGHT = np.zeros((256, len(_CLASSES)), bool)
for _k, _m in enumerate(_CLASSES):
    _WEIGHT[:, _k] = _m


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def _distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: number of different hashes, and the count of the most frequent one."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    if not len(key):
        return np.zeros(n_docs), np.zeros(n_docs)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n_docs)
    np.maximum.at(most, owner, size)
    return np.bincount(owner, minlength=n_docs), most


def statistics(arr: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, over the whole text; a null counts as empty, an empty text gives zeros."""
    data, off = X.buffers(arr)
    n_docs, size = len(off) - 1, np.maximum(1, np.diff(off))
    start, end, bounds = X.words(data, off)
    n = np.diff(bounds)
    some = np.maximum(1, n)
    doc = np.repeat(np.arange(n_docs), n)
    h = X.span_hash(X.prefix_hash(data), start, end)
    width = end - start
    shares = [_per_text(m[data], off) / size for m in _CLASSES]
    distinct, top = _distinct(h, doc, n_docs)
    pair = np.zeros(0, np.uint64)
    same = np.zeros(n_docs)
    pair_doc = doc[:-1]
    if len(h) > 1:
        inner = doc[1:] == doc[:-1]
        pair, pair_doc = X.mix(h[:-1] * np.uint64(3) + h[1:])[inner], doc[:-1][inner]
        same = np.bincount(pair_doc[(h[:-1] == h[1:])[inner]], minlength=n_docs)
    pairs, _ = _distinct(pair, pair_doc, n_docs)
    newline = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], newline + 1]))
    ls = ls[ls < len(data)]
    line_doc = np.searchsorted(off, ls, "right") - 1
    le = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, ls)], off[line_doc + 1])
    lines = np.bincount(line_doc, minlength=n_docs)
    different, _ = _distinct(X.span_hash(X.prefix_hash(data), ls, le), line_doc, n_docs)
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=run[1:])
    loud = (run[end] - run[start]) >= np.maximum(2, 0.5 * width)
    out = np.column_stack(
        [
            np.log1p(np.diff(off)), np.log1p(n), np.bincount(doc, weights=width, minlength=n_docs) / some, *shares,
            distinct / some, top / some, same / some, pairs / np.maximum(1, n - 1), size / np.maximum(1, lines), 1 - different / np.maximum(1, lines),
            np.bincount(doc[loud], minlength=n_docs) / some, np.bincount(doc[width > 20], minlength=n_docs) / some,
        ]
    )
    out[np.diff(off) == 0] = 0.0
    return out


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself. roots: the first node of each tree."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.value[node].sum(1) + self.bias)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 1.0, least: int = 5) -> Trees:
    """Boost on histograms. Without rows of both classes the model is the constant prior (0.5 without rows)."""
    n, d = x.shape
    p = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(p / (1 - p)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        feature.append(0)
        cut.append(0.0)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        flat = binned + np.arange(d) * bins
        margin = np.full(n, bias)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            g, w = q - y, np.maximum(q * (1 - q), 1e-6)
            roots.append(node(0.0))
            todo = [(roots[-1], np.arange(n), 0)]
            while todo:
                k, rows, level = todo.pop()
                gs, ws = g[rows].sum(), w[rows].sum()
                value[k] = -rate * gs / (ws + l2)
                if level < depth and len(rows) >= 2 * least:
                    where = flat[rows].ravel()
                    gh, wh, ch = (np.bincount(where, weights=None if v is None else np.repeat(v[rows], d), minlength=d * bins).reshape(d, bins).cumsum(1)[:, :-1] for v in (g, w, None))
                    gain = gh**2 / (wh + l2) + (gs - gh) ** 2 / (ws - wh + l2) - gs**2 / (ws + l2)
                    gain[(ch < least) | (len(rows) - ch < least)] = -1
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(cuts[j]):
                        feature[k], cut[k] = int(j), float(cuts[j][b])
                        left[k], right[k] = node(0.0), node(0.0)
                        low = binned[rows, j] <= b
                        todo += [(left[k], rows[low], level + 1), (right[k], rows[~low], level + 1)]
                        continue
                margin[rows] += value[k]
    if not roots:
        roots.append(node(0.0))
    a = np.array
    leaf = a(left) == np.arange(len(left))
    return Trees(a(roots), a(feature), a(cut), a(left), a(right), np.where(leaf, a(value), 0.0), bias, depth)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, seed: int = 5, **how) -> Trees:
    """Train on a bounded sample of labelled rows: about max_rows of labels, by a hash of doc_id. Labels that are null or
    contradict each other are not used, nor are documents with a null text. The sampled labels, at most about max_rows
    rows, are broadcast to find their documents; only their statistics come to the driver.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    n = usable.count()
    share = min(1.0, max_rows / max(1, n))
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = usable.filter(unit < share).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2").select("doc_id", "q")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id")

    def run(batches):
        for b in X.slices(batches, "text"):
            s = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), s.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "q", "x"])

    got = rows.select("doc_id", "text", "q").mapInArrow(X.lean(run), "doc_id long, q int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return train(x, np.array(got.column("q").to_pylist(), float), **how)


def classify(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) for every document: the probability of good quality, and whether it reaches threshold.

    A null or empty text has score 0 and is not kept. Repeated rows each get their row; other columns are ignored. Map
    side only; the broadcast model's size is set by the number and depth of its trees.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in X.slices(batches, "text"):
            s = statistics(b.column(1))
            p = np.where(s[:, 0] > 0, shared.value.predict(s), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold) & (s[:, 0] > 0))], ["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(X.lean(run), "doc_id long, score double, keep boolean")
