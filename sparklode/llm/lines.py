"""Line dedup by winnowing over line hashes.

In every window of min_lines consecutive lines the line with the least hash (the last of equals) is selected. A run of
that many lines which two places share has its window's minimum selected in both, so the selected positions are
fingerprints that no repeated run escapes. Positions with a fingerprint that occurs once drop out; the others extend to
both sides over the lines around them, and of each run that occurs again all but the first occurrence are deleted. Runs of
fewer lines count where they are long in words, if a number of words is given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import text as X

#: Documents with deletions, and deletions, up to which they are broadcast to the texts; beyond it both are shuffled.
BROADCAST_ROWS, BROADCAST_STARTS = 300_000, 4_000_000


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and where each text's lines start. An empty text has none."""
    newline = np.flatnonzero(data == 10)
    start = np.union1d(off[:-1][np.diff(off) > 0], newline + 1)
    # A text that ends in a newline has an empty last line, which starts where the next text does.
    ends_open = off[1:][(np.diff(off) > 0)]
    ends_open = ends_open[data[ends_open - 1] == 10] if len(ends_open) else ends_open
    doc = np.searchsorted(off, start, "right") - 1
    ok = start < len(data)
    start, doc = start[ok], doc[ok]
    nxt = np.searchsorted(newline, start)
    end = np.minimum(np.append(newline, len(data))[nxt], off[doc + 1])
    owner = np.searchsorted(off, ends_open, "left") - 1
    start, end, doc = np.concatenate([start, ends_open]), np.concatenate([end, ends_open]), np.concatenate([doc, owner])
    order = np.lexsort((end, start, doc))
    start, end, doc = start[order], end[order], doc[order]
    return start, end, np.searchsorted(doc, np.arange(len(off)))


def select(h: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Positions of the last minimum of every window of width values inside a text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    first = np.arange(n)
    inside = np.ones(n, bool)
    for b in range(1, width):
        c = bounds[1:-1] - b
        inside[c[(c >= 0) & (c < n)]] = False
    best, at = h[:n].copy(), first.copy()
    for k in range(1, width):
        later = h[k : k + n] <= best
        best[later] = h[k : k + n][later]
        at[later] = first[later] + k
    return np.unique(at[inside])


def fingerprints(docs: DataFrame, min_lines: int) -> DataFrame:
    """(fp, doc_id, copy, line, around): each selected position with the hashes of the min_lines - 1 lines on either side."""
    reach = min_lines - 1

    def run(batches):
        for b in X.slices(batches, "text"):
            data, off = X.buffers(b.column(2))
            start, end, bounds = line_spans(data, off)
            h = X.span_hash(X.prefix_hash(data), start, end)
            at = select(h, bounds, min_lines)
            doc = np.searchsorted(bounds, at, "right") - 1
            where = at[:, None] + np.arange(-reach, reach + 1)
            ok = (where >= bounds[doc][:, None]) & (where < bounds[doc + 1][:, None])
            signed = h.view(np.int64)
            around = pa.array(signed[np.where(ok, where, 0)].ravel(), mask=~ok.ravel())
            lists = pa.FixedSizeListArray.from_arrays(around, 2 * reach + 1).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(signed[at]), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array((at - bounds[doc]).astype(np.int32)), lists], ["fp", "doc_id", "copy", "line", "around"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text")).mapInArrow(X.lean(run), "fp long, doc_id long, copy long, line int, around array<long>")


def later_runs(docs: DataFrame, min_lines: int = 3) -> DataFrame:
    """(doc_id, copy, starts): by document, the first lines of all runs of min_lines lines that occur earlier, that is, in
    a document before it in the order of (doc_id, text hash) or above in the same one. copy is the hash of the text."""
    fps = cut(fingerprints(docs, min_lines), "fingerprints")
    again = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")
    reach = min_lines - 1
    runs = F.array(*[F.struct(F.slice("around", reach - o + 1, min_lines).alias("run"), (F.col("line") - o).alias("start")) for o in range(min_lines)])
    hit = fps.join(again, "fp").select("doc_id", "copy", F.explode(runs).alias("r")).filter(~F.exists("r.run", lambda x: x.isNull()))
    hit = hit.select(F.xxhash64("r.run").alias("run"), F.struct("doc_id", "copy", F.col("r.start").alias("start")).alias("at")).distinct()
    first = hit.groupBy("run").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("run", "first")
    return hit.join(first, "run").filter(F.col("at") > F.col("first")).groupBy("at.doc_id", "at.copy").agg(F.collect_set("at.start").alias("starts"))


def later_long_runs(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, copy, gone): by document, the lines of all runs of fewer than min_lines lines, but at least min_words words,
    that occur earlier. Such runs are few enough to be compared without winnowing."""

    def run(batches):
        for b in X.slices(batches, "text"):
            data, off = X.buffers(b.column(2))
            start, end, bounds = line_spans(data, off)
            h = X.span_hash(X.prefix_hash(data), start, end)
            word = X.words(data, off)[0]
            n = np.searchsorted(word, end) - np.searchsorted(word, start)
            doc = np.searchsorted(bounds, np.arange(len(h)), "right") - 1
            for t in range(1, min_lines):
                last = len(h) - t + 1
                if last < 1:
                    break
                whole, total = np.full(last, t, np.uint64), np.zeros(last, np.int64)
                for k in range(t):
                    whole = X.mix(whole * np.uint64(3) + h[k : k + last], k + 1)
                    total += n[k : k + last]
                at = np.flatnonzero((total >= min_words) & (doc[:last] == doc[t - 1 :]))
                own = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)[at]), b.column(0).take(own), b.column(1).take(own), pa.array((at - bounds[doc[at]]).astype(np.int32)), pa.array(np.full(len(at), t, np.int32))], ["run", "doc_id", "copy", "start", "lines"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text"))
    hit = texts.mapInArrow(X.lean(run), "run long, doc_id long, copy long, start int, lines int").select("run", F.struct("doc_id", "copy", "start").alias("at"), "lines")
    first = hit.groupBy("run").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("run", "first")
    later = hit.join(first, "run").filter(F.col("at") > F.col("first"))
    return later.groupBy("at.doc_id", "at.copy").agg(F.flatten(F.collect_set(F.sequence("at.start", F.col("at.start") + F.col("lines") - 1))).alias("gone"))


def _rewrite(text: pa.Array, starts: pa.Array, min_lines: int) -> tuple[pa.Array, np.ndarray]:
    """Texts without the runs that begin at starts, and the numbers of lines deleted."""
    at = np.flatnonzero(np.asarray(starts.is_valid()) & np.asarray(text.is_valid()))
    gone, new = np.zeros(len(text), np.int32), []
    for i in at.tolist():
        parts = text[i].as_py().split("\n")
        drop = np.zeros(len(parts), bool)
        for k in range(min_lines):
            drop[np.asarray(starts[i].values) + k] = True
        new.append("\n".join(p for p, d in zip(parts, drop) if not d))
        gone[i] = drop.sum()
    if new:
        mask = np.zeros(len(text), bool)
        mask[at] = True
        text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
    return text, gone


def _with_runs(docs: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """(__row, __dead): every row of docs as a struct, and where its later runs start; with min_words each of their lines."""
    dead = later_runs(docs, min_lines)
    if min_words is not None:
        each = dead.select("doc_id", "copy", F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (min_lines - 1)))).alias("gone"))
        both = each.unionByName(later_long_runs(docs, min_lines, min_words))
        dead = both.groupBy("doc_id", "copy").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("starts"))
    dead = cut(dead.select(F.struct("doc_id", "copy", "starts").alias("__dead")), "deletions")
    n = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__dead.starts")), F.lit(0))).first()
    if n[0] <= BROADCAST_ROWS and n[1] <= BROADCAST_STARTS:
        dead = F.broadcast(dead)
    row = docs.select(F.struct("*").alias("__row"))
    return row.join(dead, F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__dead.doc_id")) & (F.xxhash64("__row.text") == F.col("__dead.copy")), "left")


def dedup(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """(doc_id, text, n_deleted) for every document: its text without the lines of runs of at least min_lines lines that
    occur earlier in the corpus; with min_words also without the shorter runs of at least that many words.

    Lines are what newlines separate, compared byte by byte. Earlier means a lower doc_id (null first; of equal ids the
    lower text hash) or further up in the same text; of a run that overlaps itself the first min_lines lines stay. A
    document with fewer lines stays as it is unless min_words is given, so do null and empty texts. Rows that are equal in doc_id and text are one
    document and get the same result. Other columns are ignored. An empty table gives an empty result.
    """
    span = min_lines if min_words is None else 1

    def run(batches):
        for b in batches:
            text, gone = _rewrite(b.column(1), b.column(2), span)
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(gone)], ["doc_id", "text", "n_deleted"])

    rows = _with_runs(docs, min_lines, min_words).select(F.col("__row.doc_id").cast("long").alias("doc_id"), F.col("__row.text").cast("string").alias("text"), F.col("__dead.starts").alias("starts"))
    return rows.mapInArrow(X.lean(run), "doc_id long, text string, n_deleted int")


def dedup_documents(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """The rows of docs with the text of dedup; n_chars follows. Rows that lose every line, later copies, are left out.

    Null and empty texts stay as they are; repeated rows stay or go together, since they are one document; null doc_ids come
    before all others. Other columns pass through, whatever their names. An empty table gives an empty one.
    """
    span = min_lines if min_words is None else 1
    names = [c.lower() for c in docs.columns]
    extra = next(x for x in ("starts" + "_" * k for k in range(len(names) + 1)) if x not in names)
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            cols = b.columns
            text, gone = _rewrite(cols[at], cols[-1], span)
            cols[at] = text
            some = pa.array(gone > 0)
            if length is not None:
                cols[length] = pc.if_else(some, pc.utf8_length(text).cast(cols[length].type), cols[length])
            keep = pc.or_(pc.invert(some), pc.fill_null(pc.greater(pc.utf8_length(pc.utf8_trim(text, " \t\n\r")), 0), False))
            yield pa.RecordBatch.from_arrays(cols[:-1], b.schema.names[:-1]).filter(keep)

    rows = _with_runs(docs, min_lines, min_words).select(*[F.col("__row").getField(f.name).alias(f.name) for f in docs.schema.fields], F.col("__dead.starts").alias(extra))
    return rows.mapInArrow(X.lean(run), docs.schema)
