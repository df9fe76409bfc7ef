"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its word n-grams. If two sets have a Jaccard similarity of at least t, then under any global
order of tokens the first |x| - ceil(t |x|) + 1 tokens of each share one. The join takes several such orders, all of them
rarer tokens first, with different orders among the equally rare, and a pair is a candidate only if it shares a prefix
token under every one. Candidates are verified by their exact intersections.

1. Documents become sets of 48-bit tokens, each known by the hash of its tokens: copies are one set. A first pass writes
   every document's set, counts the copies, and finds the hot tokens, those of a large share of all documents.
2. A shuffle by token finds the exact number of sets that hold each other token. Tokens of one set alone are in no
   intersection; they only take places at the front of the prefixes, which leaves most sets without any prefix token to
   share. Hot tokens come last in every order and are not shuffled by token, so no task gathers their holders.
3. The tokens return to their sets. Sets with prefix tokens left are written.
4. A shuffle by prefix token under the first order gives pairs of sets; a token of many sets is split into pairs of parts.
5. Pairs are sent, by blocks of sets with the same least token, to tasks that hold the block's tokens. There the filters of
   the other orders are intersected with the first one's, and what is left is verified; whole blocks are 0/1 matrices. A
   block returns each set's number of links and a spanning forest of them, so what comes out grows with the sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import packed as P
from . import text as X
from .blocks import by_block, classes, forest

ORDERS = 3
#: Rows of keys up to which they are broadcast to a larger table; beyond it both are shuffled.
BROADCAST_ROWS = 1_000_000
#: Share of the documents, and number of them at least, from which a token is hot; the most that are sent to all tasks, the
#: commonest first. What is not hot is shuffled by token.
HOT_SHARE, HOT_LEAST, HOT_TOKENS = 1 / 200, 10_000, 2_000_000
#: Sets of one prefix token that a task pairs at once.
GROUP = 512
_HOT = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE = 2 << 20


def gram_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts laid end to end, sorted and distinct within a text, and each one's text."""
    data = _LOWER[data]
    start, end, bounds = X.words(data, off)
    h = X.span_hash(X.prefix_hash(data), start, end)
    grams, at = X.windows(h, bounds, n)
    doc = np.searchsorted(bounds, at, "right") - 1
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < n))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            there = bounds[few] + k < bounds[few + 1]
            whole[there] = X.mix(whole[there] * np.uint64(3) + h[(bounds[few] + k)[there]], k + 1)
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, few])
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (grams & P.TOKEN))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key & P.TOKEN, (key >> np.uint64(48)).astype(np.int64)


def _need(size: np.ndarray, t: float) -> np.ndarray:
    """Least intersection with any set that reaches similarity t."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def _named(gram: int, least: int):
    """docs -> (0, doc_id, set, size) of every document, set null without words, and (1, token, null, texts) of the tokens
    that at least one in fifty of a slice's texts, and least of them, hold."""

    def run(batches):
        for b in X.slices(batches, "text", _SLICE):
            tok, doc = gram_sets(*X.buffers(b.column(1)), gram)
            first, size = P.runs(doc)
            sets, sizes, none = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32), np.ones(b.num_rows, bool)
            if len(tok):
                own = doc[first]
                sets[own], sizes[own], none[own] = signature(tok, first, size), size, False
            toks, held = np.unique(tok, return_counts=True)
            many = held >= max(least, b.num_rows / 50)
            toks, held = toks[many], held[many]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([0, 1], np.int32), [b.num_rows, len(toks)])), pa.concat_arrays([b.column(0), pa.array(toks.view(np.int64))]),
                pa.concat_arrays([pa.array(sets.view(np.int64), mask=none), pa.nulls(len(toks), pa.int64())]), pa.array(np.concatenate([sizes, held]).astype(np.int32)),
            ], ["kind", "key", "set", "size"])

    return run


def signature(tok: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of sets laid end to end."""
    return X.mix(np.add.reduceat(X.mix(tok, 5), first) + size.astype(np.uint64))


def _tokens(n: int, gram: int, shared):
    """docs -> tokens by token bucket (kind 0: sets, counts, tokens), and sets by set bucket (kind 1: sets, sizes, numbers
    of hot tokens, hot tokens). shared: the hot tokens, sorted."""

    def run(batches):
        hot = shared.value

        def rows():
            for b in X.slices(batches, "text", _SLICE):
                tok, doc = gram_sets(*X.buffers(b.column(0)), gram)
                if not len(tok):
                    continue
                first, size = P.runs(doc)
                sig = signature(tok, first, size)
                _, once = np.unique(sig, return_index=True)
                if len(once) < len(sig):
                    keep = np.zeros(len(sig), bool)
                    keep[once] = True
                    tok, sig, size = tok[np.repeat(keep, size)], sig[keep], size[keep]
                owner = np.repeat(np.arange(len(sig)), size)
                known = hot[np.minimum(np.searchsorted(hot, tok), len(hot) - 1)] == tok if len(hot) else np.zeros(len(tok), bool)
                n_hot = np.bincount(owner[known], minlength=len(sig))
                bucket = (sig % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket[owner[known]], kind="stable")
                hot_tok, hot_bucket = tok[known][order], bucket[owner[known]][order]
                for k, at in P.groups(bucket, n):
                    lo, hi = np.searchsorted(hot_bucket, [k, k + 1])
                    yield k, 1, P.pack(sig[at], size[at].astype("<u4"), n_hot[at].astype("<u4"), P.six(hot_tok[lo:hi]))
                tok, owner = tok[~known], owner[~known]
                for k, at in P.groups((tok % np.uint64(n)).astype(np.int64), n):
                    f, c = P.runs(owner[at])
                    yield k, 0, P.pack(sig[owner[at][f]], c.astype("<u4"), P.six(tok[at]))

        yield from P.emit(rows())

    return run


def _entries(blobs: list, *more: str) -> list[np.ndarray]:
    """Set and token of each entry of (sets, counts, tokens, ...) blobs, and what else they hold by entry."""
    sets, toks, rest = [], [], [[] for _ in more]
    for blob in blobs:
        s, c, t, *x = P.unpack(blob, "<u8", "<u4", None, *more)
        sets.append(np.repeat(s, c))
        toks.append(P.unsix(t))
        for r, v in zip(rest, x):
            r.append(v)
    return [np.concatenate(a) if a else np.zeros(0, np.uint64) for a in (sets, toks, *rest)]


def _frequencies(n: int):
    """By token bucket -> by set bucket: tokens of at least two sets, with their number of sets."""

    def run(held):
        def rows():
            for blob in held.get(1, []):
                yield int(P.unpack(blob, "<u8")[0][0] % np.uint64(n)), 1, blob.to_pybytes()
            sets, toks = _entries(held.get(0, []))
            order = np.argsort(toks)
            toks, sets = toks[order], sets[order]
            start, size = P.runs(toks)
            more = np.repeat(size > 1, size)
            toks, sets = toks[more], sets[more]
            order = np.lexsort((sets, toks))
            toks, sets = toks[order], sets[order]
            new = np.append(True, (toks[1:] != toks[:-1]) | (sets[1:] != sets[:-1])) if len(toks) else np.zeros(0, bool)
            toks, sets = toks[new], sets[new]
            _, size = P.runs(toks)
            df = np.repeat(size, size)
            toks, sets, df = toks[df > 1], sets[df > 1], df[df > 1]
            order = np.argsort(sets, kind="stable")
            toks, sets, df = toks[order], sets[order], df[order].astype("<u4")
            for k, at in P.groups((sets % np.uint64(n)).astype(np.int64), n):
                f, c = P.runs(sets[at])
                yield k, 0, P.pack(sets[at][f], c.astype("<u4"), P.six(toks[at]), df[at])

        yield from P.emit(rows())

    return run


_SETS = "set long, size int, family long, tokens binary, df binary"


def _sets(t: float):
    """By set bucket -> sets that have enough shared tokens for a partner."""

    def run(held):
        parts = [P.unpack(b, "<u8", "<u4", "<u4", None) for b in held.get(1, [])]
        sig, size, n_hot = (np.concatenate([p[k] for p in parts]) for k in range(3))
        hot = np.concatenate([P.unsix(p[3]) for p in parts])
        sig, once = np.unique(sig, return_index=True)
        size = size[once]
        end = np.cumsum(n_hot.astype(np.int64))
        n_hot, lo = n_hot[once].astype(np.int64), end[once] - n_hot[once]
        hot = hot[np.repeat(lo - np.cumsum(n_hot) + n_hot, n_hot) + np.arange(n_hot.sum())]
        owner, toks, df = _entries(held.get(0, []), "<u4")
        owner, toks, df = np.concatenate([owner, np.repeat(sig, n_hot)]), np.concatenate([toks, hot]), np.concatenate([df, np.full(len(hot), _HOT)])
        order = np.argsort(owner, kind="stable")
        owner, toks, df = owner[order], toks[order], df[order]
        lo, hi = np.searchsorted(owner, sig, "left"), np.searchsorted(owner, sig, "right")
        out = np.flatnonzero((hi - lo >= _need(size, t)) & (hi > lo))
        for at in range(0, len(out), 2000):
            some = out[at : at + 2000]
            held_toks = [toks[lo[i] : hi[i]] for i in some]
            yield pa.RecordBatch.from_arrays([
                pa.array(sig[some].view(np.int64)), pa.array(size[some].astype(np.int32)), pa.array([int(X.mix(x, 9).min().astype(np.int64)) for x in held_toks], pa.int64()),
                pa.array([P.six(x) for x in held_toks], pa.binary()), pa.array([df[lo[i] : hi[i]].tobytes() for i in some], pa.binary()),
            ], ["set", "size", "family", "tokens", "df"])

    return run


def _rank(tok: np.ndarray, df: np.ndarray, k: int) -> np.ndarray:
    """The place of tokens in global order k: rarer first, the first order by exact and the others by rough frequency."""
    rare = df.astype(np.uint64) if k == 0 else np.floor(np.log2(df)).astype(np.uint64)
    return (rare << np.uint64(32)) | (X.mix(tok, 100 + k) >> np.uint64(32))


def _prefix(tok: np.ndarray, df: np.ndarray, size: int, t: float, k: int) -> np.ndarray:
    """The tokens of a set's prefix under order k that another set holds too; tokens of equal place belong to it together."""
    length = int(size - _need(np.array([size]), t)[0] + 1 - (size - len(tok)))
    if length < 1 or not len(tok):
        return tok[:0]
    if length >= len(tok):
        return tok
    rank = _rank(tok, df, k)
    return tok[rank <= np.partition(rank, length - 1)[length - 1]]


def _prefixes(n: int, t: float):
    """Sets -> prefix tokens under the first order by bucket: (sets, counts, tokens, sizes and families by set)."""

    def run(batches):
        def rows():
            for b in batches:
                sig, size, fam = (np.asarray(b.column(k)) for k in range(3))
                toks = [_prefix(P.unsix(b.column(3)[i].as_buffer()), np.frombuffer(b.column(4)[i].as_buffer(), "<u4"), int(size[i]), t, 0) for i in range(b.num_rows)]
                owner = np.repeat(np.arange(b.num_rows), [len(x) for x in toks])
                if not len(owner):
                    continue
                tok = np.concatenate(toks)
                for bucket, at in P.groups((tok % np.uint64(n)).astype(np.int64), n):
                    f, c = P.runs(owner[at])
                    o = owner[at][f]
                    yield bucket, 0, P.pack(sig[o].view("<u8"), c.astype("<u4"), P.six(tok[at]), size[o].astype("<u4"), fam[o])

        yield from P.emit(rows())

    return run


def _units(n: int):
    """By prefix-token bucket -> what a task pairs at once, in the bucket of the token's least set, so that the tokens which
    the same sets share meet in one task and their pairs are found once there: the tokens of up to GROUP sets (kind 0), and
    for tokens of more sets each pair of the sets' parts (kind 1: sets, sizes, families, size of the first part)."""

    def run(held):
        def rows():
            sets, toks, sizes, fams = [], [], [], []
            for blob in held.get(0, []):
                s, c, x, z, f = P.unpack(blob, "<u8", "<u4", None, "<u4", "<i8")
                toks.append(P.unsix(x))
                sets.append(np.repeat(s, c))
                sizes.append(np.repeat(z, c))
                fams.append(np.repeat(f, c))
            sets, toks, sizes, fams = (np.concatenate(a) for a in (sets, toks, sizes, fams))
            order = np.lexsort((sets, toks))
            sets, toks, sizes, fams = sets[order], toks[order], sizes[order], fams[order]
            start, length = P.runs(toks)
            some = np.repeat(length > 1, length)
            sets, toks, sizes, fams = sets[some], toks[some], sizes[some], fams[some]
            start, length = P.runs(toks)
            if not len(start):
                return
            once = _distinct(sets, start, length)
            least = np.minimum.reduceat(X.mix(sets, 13), start)
            bucket = (X.mix(least, 3) % np.uint64(n)).astype(np.int64)
            few = once & (length <= GROUP)
            entry = np.flatnonzero(np.repeat(few, length))
            for k, at in P.groups(np.repeat(bucket, length)[entry], n):
                at = entry[at]
                yield k, 0, P.pack(sets[at], P.six(toks[at]), sizes[at], fams[at])
            for k in np.flatnonzero(once & (length > GROUP)):
                own = np.arange(start[k], start[k] + length[k])
                parts = 1 << int(np.ceil(np.log2(length[k] / (GROUP // 2))))
                part = (X.mix(sets[own], 7) & np.uint64(parts - 1)).astype(np.int64)
                for i in range(parts):
                    for j in range(i, parts):
                        mine, other = own[part == i], own[part == j] if j > i else own[:0]
                        at = np.concatenate([mine, other])
                        to = int(X.mix(np.array([least[k] + np.uint64(i * parts + j)]), 5)[0] % np.uint64(n))
                        yield to, 1, P.pack(sets[at], sizes[at], fams[at], np.array([len(mine) if j > i else 0, j > i], "<i8"))

        yield from P.emit(rows())

    return run


def _distinct(sets: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of groups of sets laid end to end, those that are the first with their sets."""
    keep = np.zeros(len(start), bool)
    if len(start):
        keep[np.unique(X.mix(np.add.reduceat(X.mix(sets, 5), start) + length.astype(np.uint64)), return_index=True)[1]] = True
    return keep


def _pairs(t: float):
    """Units -> pairs of sets that share a token and whose sizes allow t, distinct within a task."""

    def out(name: np.ndarray, fam: np.ndarray, pair: np.ndarray):
        a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for lo in range(0, len(a), 500_000):
            x, y = a[lo : lo + 500_000], b[lo : lo + 500_000]
            f, g = fam[x], fam[y]
            block = X.mix(np.minimum(f, g).view(np.uint64) * np.uint64(3) + np.maximum(f, g).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(name[x].view(np.int64)), pa.array(name[y].view(np.int64))], ["block", "a", "b"])

    def run(held):
        sets, toks, sizes, fams, split, seen = [], [], [], [], [], set()
        for blob in held.get(0, []):
            s, x, z, f = P.unpack(blob, "<u8", None, "<u4", "<i8")
            for r, v in zip((sets, toks, sizes, fams), (s, P.unsix(x), z, f)):
                r.append(v)
        for blob in held.get(1, []):
            s, z, f, (first, cross) = P.unpack(blob, "<u8", "<u4", "<i8", "<i8")
            what = s.tobytes()
            if what in seen:
                continue
            seen.add(what)
            split.append((len(s), int(first), bool(cross)))
            for r, v in zip((sets, toks, sizes, fams), (s, np.zeros(len(s), np.uint64), z, f)):
                r.append(v)
        sets, toks, sizes, fams = (np.concatenate(a) for a in (sets, toks, sizes, fams))
        n_few = len(sets) - sum(n for n, _, _ in split)
        name, where, local = np.unique(sets, return_index=True, return_inverse=True)
        size, fam = sizes[where].astype(np.int64), fams[where]
        found, held_n = [], 0

        def add(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal found, held_n
            ok = (a != b) & (np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9)
            a, b = a[ok].astype(np.uint64), b[ok].astype(np.uint64)
            found.append(np.unique((np.minimum(a, b) << np.uint64(32)) | np.maximum(a, b)))
            held_n += len(found[-1])
            if held_n > 6_000_000:
                found = [np.unique(np.concatenate(found))]
                held_n = len(found[0]) // 2

        order = np.lexsort((local[:n_few], toks[:n_few]))
        few = local[:n_few][order]
        start, length = P.runs(toks[:n_few][order])
        once = _distinct(name[few], start, length)
        start, length = start[once], length[once]
        for d in np.unique(length):
            at, (i, j), step = start[length == d], np.triu_indices(d, 1), max(1, 4_000_000 // int(d * d))
            for lo in range(0, len(at), step):
                add(few[at[lo : lo + step, None] + i].ravel(), few[at[lo : lo + step, None] + j].ravel())
        at = n_few
        for n, first, cross in split:
            own = local[at : at + n]
            at += n
            i, j = (np.repeat(np.arange(first), n - first), np.tile(np.arange(first, n), first)) if cross else np.triu_indices(n, 1)
            add(own[i], own[j])
        if found:
            yield from out(name, fam, np.unique(np.concatenate(found)))

    return run


def _meet(member: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of members a and b."""
    if len(a) <= 2:
        return np.array([len(np.intersect1d(member[i], member[j], assume_unique=True)) for i, j in zip(a, b)])
    flat, row = np.concatenate(member), np.repeat(np.arange(len(member)), [len(m) for m in member])
    toks, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # what one member alone has is in no intersection
    row, col, toks = row[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]], toks[shared]
    out = np.zeros(len(a), np.int64)
    width = max(1, 4_000_000 // len(member))
    for lo in range(0, len(toks), width):
        at = np.flatnonzero((col >= lo) & (col < lo + width))
        m = np.zeros((len(member), min(width, len(toks) - lo)), np.float32)
        m[row[at], col[at] - lo] = 1
        for r in range(0, len(member), 1024):
            mine = np.flatnonzero((a >= r) & (a < r + 1024))
            if len(mine):
                out[mine] += np.rint((m[r : r + 1024] @ m.T)[a[mine] - r, b[mine]]).astype(np.int64)
    return out


def _block(t: float):
    """(members, pairs) of one block -> the links of those pairs that pass the other orders' filters and reach t."""

    def run(members: pa.RecordBatch, pairs: pa.RecordBatch) -> pa.RecordBatch | None:
        name = np.asarray(members.column(2))
        order = np.argsort(name)
        a, b = (order[np.searchsorted(name, np.asarray(pairs.column(k)), sorter=order)] for k in (2, 3))
        size = np.asarray(members.column(4)).astype(np.int64)
        tok = [P.unsix(x.as_buffer()) for x in members.column(6)]
        df = [np.frombuffer(x.as_buffer(), "<u4") for x in members.column(7)]
        for k in range(1, ORDERS):
            ok = _meet([_prefix(x, d, int(z), t, k) for x, d, z in zip(tok, df, size)], a, b) > 0
            a, b = a[ok], b[ok]
            if not len(a):
                return None
        common = _meet(tok, a, b)
        ok = common / (size[a] + size[b] - common) >= t - 1e-12
        return forest(name, np.asarray(members.column(5)), a[ok], b[ok])

    return run


#: Sets in a block beyond which it is split into pairs of parts of half as many.
BLOCK_SETS = 1024


def _split(candidates: DataFrame) -> DataFrame:
    """candidates, those of large blocks in blocks of their own for each pair of the sets' parts."""
    members = candidates.select("block", F.explode(F.array("a", "b")).alias("set")).distinct()
    large = cut(members.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_SETS).select("block", F.ceil(F.col("n") / (BLOCK_SETS // 2)).alias("parts")), "large-blocks")
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    part = F.xxhash64("block", F.pmod(F.xxhash64("a"), F.col("parts")), F.pmod(F.xxhash64("b"), F.col("parts")))
    return candidates.join(large, "block", "left").select(F.when(F.col("parts").isNull(), F.col("block")).otherwise(part).alias("block"), "a", "b")


def links(docs: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """(doc_id, class_id, n_links), one row for each doc_id: links are to the documents whose sets of word n-grams have a
    Jaccard similarity of at least threshold with its own, copies included; class_id is the least doc_id that links lead to.

    Words are what ASCII white space separates, ASCII letters in lower case. A text of fewer than n words has one n-gram,
    all of it. A null text, or one without words, has no link, and its document is a class by itself. Repeated rows (same
    doc_id and set) are one document. A doc_id with several different sets gets the least class and the sum of the links
    of them. Null doc_ids have one row without class and without links, and nothing links to them. Other columns are
    ignored. An empty table gives no rows. Exact up to collisions of the 48-bit tokens.
    """
    spark, buckets = docs.sparkSession, P.partitions(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = cut(texts.mapInArrow(X.lean(_named(n, min(4, HOT_LEAST))), "kind int, key long, set long, size int"), "named")
    entries = cut(named.filter("kind = 0").select(F.col("key").alias("doc_id"), "set").distinct(), "entries")
    least = max(HOT_LEAST, named.filter("kind = 0").count() * HOT_SHARE)
    common = named.filter("kind = 1").groupBy("key").agg(F.sum("size").alias("texts")).filter(F.col("texts") >= least)
    hot = np.sort(np.array([r["key"] for r in common.orderBy(F.desc("texts"), "key").limit(HOT_TOKENS).collect()], np.int64).view(np.uint64))
    copies = cut(entries.filter("set IS NOT NULL AND doc_id IS NOT NULL").groupBy("set").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")), "copies")

    own = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("text")
    tokens = own.mapInArrow(X.lean(_tokens(buckets, n, spark.sparkContext.broadcast(hot))), P.SCHEMA)
    shared = P.exchange(tokens, buckets, _frequencies(buckets))
    sets = cut(P.exchange(shared, buckets, _sets(threshold), _SETS), "sets")
    units = P.exchange(sets.mapInArrow(X.lean(_prefixes(buckets, threshold)), P.SCHEMA), buckets, _units(buckets))
    candidates = _split(cut(P.exchange(units, buckets, _pairs(threshold), "block long, a long, b long").distinct(), "candidates"))
    who = candidates.select("block", F.explode(F.array("a", "b")).alias("set")).distinct().join(copies.select("set", "copies"), "set")
    who = cut(who, "members")
    if who.count() <= BROADCAST_ROWS:
        who = F.broadcast(who)
    none = F.lit(None)
    members = sets.join(who, "set").select("block", F.lit(0).alias("kind"), "set", none.cast("long").alias("other"), "size", "copies", "tokens", "df")
    wanted = candidates.select("block", F.lit(1).alias("kind"), F.col("a").alias("set"), F.col("b").alias("other"), none.cast("int").alias("size"), none.cast("long").alias("copies"), none.cast("binary").alias("tokens"), none.cast("binary").alias("df"))
    found = by_block(members.unionByName(wanted), buckets, _block(threshold))
    return classes(entries, copies, found, "set", "doc_id")


def keep_one(docs: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """The rows of docs, all columns as they are, without all but one document of each group of near duplicates.

    A group is a class of links; the document with the least doc_id (null first, of equal ids the
    one with the lower text hash) stays. Rows equal in doc_id and text are one document and stay or go together. A null
    doc_id is a value like others here. Null texts and texts without words stay.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(F.struct("*").alias("__row"))
    own = F.xxhash64(F.col("__row.doc_id").cast("long"), F.col("__row.text").cast("string"))
    members = cut(links(docs.select(key.alias("doc_id"), "text"), threshold, n).filter("n_links > 0").select(F.col("doc_id").alias("key"), F.col("class_id").alias("group")), "groups")
    named = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id")).join(members, "key")
    best = named.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("best"))
    removed = cut(members.join(best, "group").filter(F.col("key") != F.col("best.key")).select(F.col("key").alias("__key")).distinct(), "removed")
    if removed.count() <= BROADCAST_ROWS:
        removed = F.broadcast(removed)
    return rows.join(removed, own == F.col("__key"), "left_anti").select("__row.*")
