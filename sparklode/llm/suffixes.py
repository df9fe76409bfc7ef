"""Suffix-array dedup: passages that occur more than once, found by sorting suffixes.

The corpus is a sequence of words, its suffixes start at words. Two suffixes belong to a repeated passage if they share
their first min_words words, so the suffixes can be sorted apart as long as such two stay together: each goes to the
partition of a word n-gram inside those words, the one with the least hash. Where that n-gram occurs once the suffixes
need no sorting at all. Each partition is sorted deep-shallow: by multikey quicksort to a shallow depth, and the groups
that are still equal there by blind tries, which compare members to one of them only and branch where they first differ.
Neighbours that agree to the full depth are repeats. Copies of a text are sorted once.

1. The n-grams with the least hashes, by shuffle: which of them occur in more than one place.
2. Those places return to their texts, which meet there in a second shuffle, copies with copies.
3. The words around them go to the n-gram's partition, and their suffixes are sorted.
4. Repeated positions return to their texts and merge into spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P
from . import text as X

_SCHEMA = "doc_id long, kind string, start_word long, end_word long"


def _first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray, lo: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that suffixes a and b share, depth at most, if they share lo; and the words of each behind those."""
    lcp = np.full(len(a), depth, np.int64)
    wa, wb = np.zeros(len(a), words.dtype), np.zeros(len(a), words.dtype)
    span = np.arange(lo, depth)
    for k in range(0, len(a), 100_000):
        x, y = words[a[k : k + 100_000, None] + span], words[b[k : k + 100_000, None] + span]
        differ = x != y
        at = differ.argmax(1)
        row = np.arange(len(at))
        some = differ[row, at]
        lcp[k : k + 100_000][some] = at[some] + lo
        wa[k : k + 100_000], wb[k : k + 100_000] = x[row, at], y[row, at]
    return lcp, wa, wb


def deep_shallow(words: np.ndarray, starts: np.ndarray, depth: int, shallow: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first depth words, each of which must be there, and the words that each
    one in that order shares with the one before (depth at most; 0 for the first)."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shallow = min(shallow, depth)
    # Multikey quicksort: groups that are equal so far are split by the next word.
    order, group = np.arange(n), np.zeros(n, np.int64)
    lcp = np.zeros(n, np.int64)
    live = np.arange(n)
    for d in range(shallow):
        if not len(live):
            break
        w = words[starts[order[live]] + d]
        by = np.lexsort((w, group[live]))
        order[live] = order[live][by]
        w, g = w[by], group[live]
        fresh = np.append(True, (g[1:] == g[:-1]) & (w[1:] != w[:-1]))
        fresh[0] = False
        lcp[live[fresh]] = d
        edge = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))
        group[live] = live[np.flatnonzero(edge)[np.cumsum(edge) - 1]]
        size = np.diff(np.append(np.flatnonzero(edge), len(live)))
        live = live[np.repeat(size > 1, size)]
    # Blind tries on the rest, all groups at once: one member is the path, the others branch off it.
    if shallow == depth and len(live):
        lcp[live[np.append(False, group[live][1:] == group[live][:-1])]] = depth
        live = live[:0]
    while len(live):
        g = group[live]
        edge = np.append(True, g[1:] != g[:-1])
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(live)))
        mine = starts[order[live]]
        path = np.repeat(mine[first], size)
        at, w, pw = _first_difference(words, mine, path, shallow, depth)
        side = np.where(at == depth, 1, np.where(w < pw, 0, 2))
        by = np.lexsort((w, np.where(side == 0, at, -at), side, g))
        order[live] = order[live][by]
        at, w, side = at[by], w[by], side[by]
        same = np.append(False, (g[1:] == g[:-1]) & (side[1:] == side[:-1]) & (at[1:] == at[:-1]) & ((w[1:] == w[:-1]) | (side[1:] == 1)))
        inner = ~edge & ~same
        lcp[live[inner]] = np.minimum(at[1:], at[:-1])[inner[1:]]
        lcp[live[same & (side == 1)]] = depth
        start = np.flatnonzero(~same)
        group[live] = live[np.repeat(start, np.diff(np.append(start, len(live))))]
        size = np.diff(np.append(start, len(live)))
        live = live[np.repeat((size > 1) & (side[start] != 1), size)]
    return order, lcp


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the position of its last minimum."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(g)), 1

    def better(a, b):
        return np.where(g[b] <= g[a], b, a)

    while span * 2 <= width:
        at = better(at[: len(at) - span], at[span:])
        span *= 2
    return better(at[:n], at[width - span : width - span + n])


def _owners(data: np.ndarray, off: np.ndarray, min_words: int, gram: int):
    """Word hashes and bounds of the texts; the suffixes with min_words words; and for each the n-gram that places it, with
    all n-grams' hashes."""
    start, end, bounds = X.words(data, off)
    h = X.span_hash(X.prefix_hash(data), start, end)
    g = X.rolling(h, gram)
    m = _least(g, min_words - gram + 1)
    n = np.diff(bounds)
    last = np.repeat(bounds[1:], n)[: len(m)]
    s = np.flatnonzero(np.arange(len(m)) + min_words <= last)
    return h, bounds, s, m[s], g


def _places(n: int, min_words: int, gram: int):
    """docs -> by n-gram bucket: (texts, counts, n-grams, positions)."""

    def run(batches):
        def rows():
            for b in X.slices(batches, "text", 2 << 20):
                data, off = X.buffers(b.column(1))
                _, bounds, _, m, g = _owners(data, off, min_words, gram)
                if not len(m):
                    continue
                at = m[np.append(True, m[1:] != m[:-1])]
                doc = np.searchsorted(bounds, at, "right") - 1
                text = np.asarray(b.column(0)).view(np.uint64)
                key = g[at] & P.TOKEN
                pos = (at - bounds[doc]).astype("<u4")
                for k, i in P.groups((key % np.uint64(n)).astype(np.int64), n):
                    f, c = P.runs(doc[i])
                    yield k, 0, P.pack(text[doc[i][f]], c.astype("<u4"), P.six(key[i]), pos[i])

        yield from P.emit(rows())

    return run


def _again(n: int):
    """By n-gram bucket -> by text bucket (kind 1): places whose n-gram is in more than one: (texts, counts, positions)."""

    def run(held):
        def rows():
            parts = [P.unpack(b, "<u8", "<u4", None, "<u4") for b in held[0]]
            text = np.concatenate([np.repeat(t, c) for t, c, _, _ in parts])
            key = np.concatenate([P.unsix(k) for _, _, k, _ in parts])
            pos = np.concatenate([p for _, _, _, p in parts])
            order = np.argsort(key)
            _, size = P.runs(key[order])
            i = order[np.repeat(size > 1, size)]
            i = i[np.lexsort((pos[i], text[i], key[i]))]
            new = np.append(True, (key[i][1:] != key[i][:-1]) | (text[i][1:] != text[i][:-1]) | (pos[i][1:] != pos[i][:-1])) if len(i) else np.zeros(0, bool)
            i = i[new]
            _, size = P.runs(key[i])
            i = i[np.repeat(size > 1, size)]
            i = i[np.lexsort((pos[i], text[i]))]
            for k, at in P.groups((text[i] % np.uint64(n)).astype(np.int64), n):
                f, c = P.runs(text[i][at])
                yield k, 1, P.pack(text[i][at][f], c.astype("<u4"), pos[i][at])

        yield from P.emit(rows())

    return run


def _texts(n: int):
    """docs -> by text bucket (kind 0): (ids, texts, lengths, bytes)."""

    def run(batches):
        def rows():
            for b in X.slices(batches, "text", 2 << 20):
                data, off = X.buffers(b.column(2))
                ids, text = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
                size = np.diff(off)
                for k, at in P.groups((text % np.uint64(n)).astype(np.int64), n):
                    yield k, 0, P.pack(ids[at].astype("<i8"), text[at], size[at].astype("<i8"), b"".join(data[off[i] : off[i + 1]].tobytes() for i in at))

        yield from P.emit(rows())

    return run


def _regions(n: int, min_words: int, gram: int):
    """By text bucket -> by n-gram bucket (kind 0): the suffixes at each place and their words; and, to the same bucket
    (kind 1), what is known of texts: (texts, first ids, numbers of words) and their ids."""

    def run(held):
        where: dict[int, list] = {}
        for blob in held.get(1, []):
            t, c, p = P.unpack(blob, "<u8", "<u4", "<u4")
            for name, part in zip(t.tolist(), np.split(p, np.cumsum(c)[:-1])):
                where.setdefault(name, []).append(part)
        ids: dict[int, list[int]] = {}
        first: dict[int, memoryview] = {}
        for blob in held.get(0, []):
            i, t, size, raw = P.unpack(blob, "<i8", "<u8", "<i8", None)
            ends = np.cumsum(size)
            for who, name, lo, hi in zip(i.tolist(), t.tolist(), (ends - size).tolist(), ends.tolist()):
                ids.setdefault(name, []).append(who)
                first.setdefault(name, raw[lo:hi])
        names = [x for x in first if x in where or len(ids[x]) > 1]

        def rows():
            lo = 0
            while lo < len(names):
                hi, size = lo, 0
                while hi < len(names) and (hi == lo or size + len(first[names[hi]]) <= X.SLICE_BYTES):
                    size += len(first[names[hi]])
                    hi += 1
                part, lo = names[lo:hi], hi
                data = np.frombuffer(b"".join(first[x] for x in part), np.uint8)
                off = np.concatenate([[0], np.cumsum([len(first[x]) for x in part])])
                h, bounds, s, m, g = _owners(data, off, min_words, gram)
                text = np.array(part, np.uint64)
                whole = [np.unique(ids[x]) for x in part]
                rep = np.array([w[0] for w in whole], np.int64)
                for k, at in P.groups((text % np.uint64(n)).astype(np.int64), n):
                    yield k, 1, P.pack(text[at], np.diff(bounds)[at].astype("<i8"), np.array([len(whole[i]) for i in at], "<u4"), np.concatenate([whole[i] for i in at]).astype("<i8"))
                if not len(s):
                    continue
                begin = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                count = np.diff(np.append(begin, len(m)))
                at, f = m[begin], s[begin]
                doc = np.searchsorted(bounds, at, "right") - 1
                wanted = np.concatenate([np.concatenate(where[x]).astype(np.int64) + bounds[d] for d, x in enumerate(part) if x in where] or [np.zeros(0, np.int64)])
                i = np.flatnonzero(np.isin(at, wanted))
                at, f, count, doc = at[i], f[i], count[i], doc[i]
                key = g[at] & P.TOKEN
                short = (h >> np.uint64(32)).astype("<u4")
                length = count + min_words - 1
                for k, j in P.groups((key % np.uint64(n)).astype(np.int64), n):
                    base = np.cumsum(length[j]) - length[j]
                    flat = short[np.repeat(f[j] - base, length[j]) + np.arange(length[j].sum())]
                    yield k, 0, P.pack(text[doc[j]], rep[doc[j]], (f - bounds[doc])[j].astype("<u4"), count[j].astype("<u4"), flat)

        yield from P.emit(rows())

    return run


def _sort(n: int, min_words: int):
    """By n-gram bucket -> by text bucket (kind 0): repeated positions: (texts, counts, positions, whether an earlier one exists)."""

    def run(held):
        def rows():
            for blob in held.get(1, []):
                yield int(P.unpack(blob, "<u8")[0][0] % np.uint64(n)), 1, blob.to_pybytes()
            parts = [P.unpack(b, "<u8", "<i8", "<u4", "<u4", "<u4") for b in held.get(0, [])]
            if not parts:
                return
            text, rep, begin, count, words = (np.concatenate([p[k] for p in parts]) for k in range(5))
            count = count.astype(np.int64)
            length = count + min_words - 1
            base = np.cumsum(length) - length
            run_base = np.cumsum(count) - count
            inner = np.arange(count.sum()) - np.repeat(run_base, count)
            starts = np.repeat(base, count) + inner
            owner, pos = np.repeat(np.arange(len(text)), count), np.repeat(begin.astype(np.int64), count) + inner
            order, lcp = deep_shallow(words, starts, min_words)
            edge = np.flatnonzero(lcp < min_words)
            size = np.diff(np.append(edge, len(order)))
            more = np.repeat(size > 1, size)
            i, group = order[more], np.repeat(np.arange(len(size)), size)[more]
            i, group = (x[np.lexsort((pos[i], text[owner[i]], rep[owner[i]], group))] for x in (i, group))
            later = np.append(False, group[1:] == group[:-1]) if len(i) else np.zeros(0, bool)
            t, p = text[owner[i]], pos[i].astype("<u4")
            by = np.lexsort((p, t))
            t, p, later = t[by], p[by], later[by]
            for k, at in P.groups((t % np.uint64(n)).astype(np.int64), n):
                f, c = P.runs(t[at])
                yield k, 0, P.pack(t[at][f], c.astype("<u4"), p[at], later[at].astype(np.uint8))

        yield from P.emit(rows())

    return run


def _merge(pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the spans of width words at sorted positions."""
    new = np.flatnonzero(np.append(True, pos[1:] > pos[:-1] + width))
    return pos[new], np.append(pos[new[1:] - 1], pos[-1]) + width


def _spans(min_words: int):
    def run(held):
        known: dict[int, tuple[int, np.ndarray]] = {}
        for blob in held.get(1, []):
            t, n_words, c, ids = P.unpack(blob, "<u8", "<i8", "<u4", "<i8")
            for name, n, part in zip(t.tolist(), n_words.tolist(), np.split(ids, np.cumsum(c)[:-1])):
                known[name] = (n, part)
        parts = [P.unpack(b, "<u8", "<u4", "<u4", np.uint8) for b in held.get(0, [])]
        text = np.concatenate([np.repeat(t, c) for t, c, _, _ in parts]) if parts else np.zeros(0, np.uint64)
        pos = np.concatenate([p for _, _, p, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        later = np.concatenate([x for _, _, _, x in parts]).astype(bool) if parts else np.zeros(0, bool)
        order = np.lexsort((pos, text))
        text, pos, later = text[order], pos[order], later[order]
        f, c = P.runs(text)
        at = {int(name): (lo, lo + k) for name, lo, k in zip(text[f], f, c)}
        rows: list[tuple] = []
        for name, (n, ids) in known.items():
            lo, hi = at.get(name, (0, 0))
            if len(ids) > 1 and n >= min_words:
                rows += [(i, "repeated", 0, n) for i in ids.tolist()] + [(i, "later", 0, n) for i in ids[1:].tolist()]
            elif hi > lo:
                rows += [(int(ids[0]), "repeated", int(x), int(y)) for x, y in zip(*_merge(pos[lo:hi], min_words))]
            mine = pos[lo:hi][later[lo:hi]]
            if len(mine):
                rows += [(int(ids[0]), "later", int(x), int(y)) for x, y in zip(*_merge(mine, min_words))]
        for lo in range(0, len(rows), 100_000):
            i, kind, x, y = zip(*rows[lo : lo + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(kind), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["doc_id", "kind", "start_word", "end_word"])

    return run


def repeats(docs: DataFrame, min_words: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, kind, start_word, end_word): the spans of words of every document that consist of passages of at least
    min_words words which occur more than once in the corpus.

    kind 'repeated': they occur in another document or at another place of this one; overlapping and touching passages
    are one span. kind 'later': the part of them that an earlier occurrence repeats, in a lower doc_id or further up; it
    can be deleted. Words are what ASCII white space separates, compared byte by byte by 32 bits of their hashes over all
    min_words words. Documents with a null doc_id or text take no part, nor do shorter ones. Rows equal in doc_id and
    text count once. Where one doc_id has several texts, each has spans of its own under that id, and the lower text hash
    is the earlier. Other columns are ignored. An empty table gives no rows.
    """
    n = P.partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND length(text) > 0")
    again = P.exchange(rows.select("hash", "text").mapInArrow(X.lean(_places(n, min_words, gram)), P.SCHEMA), n, _again(n))
    regions = P.exchange(rows.mapInArrow(X.lean(_texts(n)), P.SCHEMA).unionByName(again), n, _regions(n, min_words, gram))
    return P.exchange(P.exchange(regions, n, _sort(n, min_words)), n, _spans(min_words), _SCHEMA)
