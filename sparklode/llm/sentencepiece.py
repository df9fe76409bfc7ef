"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

A text becomes the marker, then itself with every space replaced by the marker (identity normalisation, dummy prefix).
Where no piece holds a marker behind another character, no piece crosses the start of a marker run, so the best path of
a text is the best paths of its chunks (marker run plus what follows) one after another. Chunks repeat, so each distinct
chunk of a slice is solved once, all of them in step, as numpy arrays. Characters that no piece starts are spelled in
byte pieces with a score below that of any piece. So is a marker that the text itself holds, which keeps it apart from a
space: decoding gives every text back.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

MARK = "▁".encode()
#: First byte under which a text's own markers pass the lattice: no UTF-8 text holds it, and no piece starts with it.
_OWN = 0xFE
_UNK_PENALTY = 10.0
_LATTICE_BYTES = 1 << 18


@dataclass
class Vocabulary:
    pieces: list[bytes]  # surface of each id; a byte piece is its byte
    scores: np.ndarray  # log score of each id; -inf: never chosen by the lattice
    byte_ids: np.ndarray  # id of each byte's piece, or -1
    control: np.ndarray  # ids that decode to nothing
    unk: int
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    unk_score: float


def _fields(buf: bytes):
    """Protocol-buffer fields: (number, value), values of length-delimited fields as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = buf[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, buf[at : at + size]
            at += size


def double_array(keys: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double-array trie: from state s, byte c leads to base[s] + c if check there is s; value is the id ending there or -1."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    low = 1
    stack = [(0, 0, len(order), 0)]
    while stack:
        s, lo, hi, depth = stack.pop()
        groups, k = [], lo
        while k < hi:
            key = keys[order[k]]
            if len(key) == depth:
                value[s] = ids[order[k]]
                k += 1
                continue
            c, start = key[depth], k
            while k < hi and keys[order[k]][depth] == c:
                k += 1
            groups.append((c, start, k))
        if not groups:
            continue
        cs = np.array([g[0] for g in groups])
        while not free[low]:
            low += 1
        b = max(1, low - int(cs[0]))
        while True:
            if b + 256 >= len(free):
                base, check, value = (np.concatenate([a, np.full(len(a), fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                free = np.concatenate([free, np.ones(len(free), bool)])
            span = free[b + int(cs[0]) : b + int(cs[0]) + 4096]
            if not free[b + cs].all():
                later = np.flatnonzero(span[1:])
                b += int(later[0]) + 1 if len(later) else 4096
                continue
            break
        base[s] = b
        for c, start, end in groups:
            t = b + c
            check[t], free[t] = s, False
            stack.append((t, start, end, depth + 1))
    return base, check, value


def load(path: str) -> Vocabulary:
    """Vocabulary of a .model file. Scores of a Unigram model are used as they are. A BPE model's scores are negative
    merge ranks, no log scores, so they become the Zipf log probabilities of those ranks, -log(rank + 2) - log(H); runs
    of markers without a rank get their length times the score of the rank-0 marker piece, so that a run stays one piece.
    """
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds, model_type = [], [], [], 1
    for number, v in _fields(raw):
        if number == 1:
            d = dict(_fields(v))
            pieces.append(d[1])
            scores.append(float(np.frombuffer(d[2], "<f4")[0]) if 2 in d else 0.0)
            kinds.append(d.get(3, 1))
        elif number == 2:
            model_type = dict(_fields(v)).get(3, 1)
    return build(pieces, np.array(scores), kinds, model_type)


def build(pieces: list[bytes], scores: np.ndarray, kinds: list[int], model_type: int = 1) -> Vocabulary:
    kind = np.array(kinds)
    usable = (kind == 1) | (kind == 4)
    if model_type == 2:
        rank = np.maximum(0.0, -scores)
        n = int(usable.sum())
        scores = -np.log(rank + 2) - np.log(np.log(n + 2))
        runs = np.array([p.replace(MARK, b"") == b"" for p in pieces])
        scores = np.where(runs & (rank > 1e8), -np.log(2.0) - np.log(np.log(n + 2)), scores)
    scores = np.where(usable, scores, -np.inf)
    byte_ids = np.full(256, -1, np.int64)
    surface = list(pieces)
    for i in np.flatnonzero(kind == 6):
        b = int(pieces[i][3:5], 16)
        byte_ids[b], surface[i] = i, bytes([b])
    for p in (pieces[i] for i in np.flatnonzero(usable)):
        if MARK in p[len(MARK) :] and p.replace(MARK, b"") and not p.startswith(MARK * (p.count(MARK))):
            raise ValueError("a piece holds a marker behind another character; chunks would not be independent")
    at = np.flatnonzero(usable)
    base, check, value = double_array([pieces[i] for i in at], at.tolist())
    unk = int(np.flatnonzero(kind == 2)[0]) if (kind == 2).any() else 0
    return Vocabulary(surface, scores, byte_ids, np.flatnonzero((kind == 3)), unk, base, check, value, float(scores[at].min()) - _UNK_PENALTY)


def _edges(v: Vocabulary, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lattice edges (start, end, id) over laid-out chunks; end: by byte, where its chunk ends."""
    lead = (data & 0xC0) != 0x80
    start = np.flatnonzero(lead)
    at, state, pos, lasts, ids, froms = start, np.zeros(len(start), np.int64), start.copy(), [], [], []
    stop = end[start]
    while len(at):
        nxt = v.base[state] + data[pos].astype(np.int64)
        ok = (v.base[state] > 0) & (v.check[np.minimum(nxt, len(v.check) - 1)] == state) & (nxt < len(v.check))
        at, state, pos, stop = at[ok], nxt[ok], pos[ok] + 1, stop[ok]
        hit = v.value[state] >= 0
        froms.append(at[hit])
        lasts.append(pos[hit])
        ids.append(v.value[state[hit]])
        go = pos < stop
        at, state, pos, stop = at[go], state[go], pos[go], stop[go]
    return np.concatenate(froms), np.concatenate(lasts), np.concatenate(ids).astype(np.int64)


def _solve(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of the chunks data[off[i]:off[i + 1]]: ids laid end to end and their offsets.

    Ties go to the edge that starts first, the longest piece; an unknown character loses them all.
    """
    n = len(data)
    length = np.diff(off)
    chunk = np.repeat(np.arange(len(length)), length)
    f, t, ids = _edges(v, data, off[1:][chunk])
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(lead, n))
    single = np.zeros(n, bool)
    single[f[t - f == width[np.searchsorted(lead, f)]]] = True
    lone = ~single[lead]
    f = np.concatenate([f, lead[lone]])
    t = np.concatenate([t, (lead + width)[lone]])
    s = np.concatenate([v.scores[ids], np.full(int(lone.sum()), v.unk_score)])
    ids = np.concatenate([ids, np.full(int(lone.sum()), -1)])
    # The step of an edge is its end inside the chunk; edges of one step are settled together.
    step = t - off[chunk[f]]
    order = np.lexsort((f, t, step))
    f, t, s, ids, step = f[order], t[order], s[order], ids[order], step[order]
    best = np.full(n + len(length) + 1, -np.inf)  # node of byte position p in chunk c: p + c
    back = np.zeros(n + len(length) + 1, np.int64)
    best[off[:-1] + np.arange(len(length))] = 0.0
    node_f, node_t = f + chunk[f], t + chunk[f]
    cuts = np.flatnonzero(np.diff(step, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(step))):
        total = best[node_f[lo:hi]] + s[lo:hi]
        first = np.flatnonzero(np.diff(node_t[lo:hi], prepend=-1))
        top = np.maximum.reduceat(total, first)
        win = np.flatnonzero(total == np.repeat(top, np.diff(np.append(first, hi - lo))))
        to = node_t[lo + win]
        keep = np.flatnonzero(np.diff(to, prepend=-1))
        best[to[keep]] = total[win[keep]]
        back[to[keep]] = lo + win[keep]
    # Backtrack all chunks in step.
    live = np.arange(len(length))[length > 0]
    node = off[live + 1] + live
    out_c, out_i, out_f, depth = [], [], [], []
    k = 0
    while len(live):
        e = back[node]
        out_c.append(live)
        out_i.append(e)
        depth.append(np.full(len(live), k))
        k += 1
        node = node_f[e]
        go = f[e] > off[live]
        live, node = live[go], node[go]
    if not out_c:
        return np.zeros(0, np.int64), np.zeros(len(length) + 1, np.int64)
    c, e, d = np.concatenate(out_c), np.concatenate(out_i), np.concatenate(depth)
    order = np.lexsort((-d, c))
    c, e = c[order], e[order]
    # Unknown characters become their bytes.
    lone = ids[e] < 0
    if v.byte_ids.min() >= 0:
        reps = np.where(lone, t[e] - f[e], 1)
        where = np.repeat(np.arange(len(e)), reps)
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        got = np.where(lone[where], v.byte_ids[data[np.minimum(f[e][where] + inner, n - 1)]], ids[e][where])
        c = c[where]
    else:
        got = np.where(lone, v.unk, ids[e])
    return got, np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(length)))])


def encode(v: Vocabulary, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts laid end to end, and their offsets. A null or empty text has none."""
    raw, off = X.buffers(arr)
    own = np.flatnonzero((raw[:-2] == MARK[0]) & (raw[1:-1] == MARK[1]) & (raw[2:] == MARK[2]))
    if len(own):
        raw = raw.copy()
        raw[own] = _OWN
    # Marked text: a marker before each text, and in place of each space.
    n_docs = len(off) - 1
    filled = np.diff(off) > 0
    grow = np.ones(len(raw), np.int64)
    grow[raw == 32] = 3
    heads = np.zeros(len(raw) + 1, np.int64)
    np.add.at(heads, off[:-1][filled], 3)
    pos = np.cumsum(grow) - grow + np.cumsum(heads)[: len(raw)]
    size = int(grow.sum() + heads.sum())
    data = np.empty(size, np.uint8)
    spaces = pos[raw == 32]
    plain = raw != 32
    data[pos[plain]] = raw[plain]
    starts = pos[off[:-1][filled]] - 3
    for k in range(3):
        data[spaces + k] = MARK[k]
        data[starts + k] = MARK[k]
    total = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(grow, 0), np.minimum(off[:-1], len(raw))) * filled + 3 * filled)]) if n_docs else np.zeros(1, np.int64)
    # Chunk starts: a marker that no marker precedes, and each text's start.
    mark = np.zeros(size + 1, bool)
    mark[spaces] = True
    mark[starts] = True
    after = np.zeros(size + 4, bool)
    after[spaces + 3] = True
    after[starts + 3] = True
    begin = mark[:size] & ~after[:size]
    begin[starts] = True
    cut = np.flatnonzero(begin)
    if not len(cut):
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    stop = np.append(cut[1:], size)
    h = X.span_hash(X.prefix_hash(data), cut, stop)
    _, example, where = np.unique(h, return_index=True, return_inverse=True)
    s, width = cut[example], (stop - cut)[example]
    # Chunks of like length together, in pieces that bound the lattice's memory.
    order = np.argsort(width, kind="stable")
    piece = np.cumsum(width[order]) // _LATTICE_BYTES
    first, reps, ids, done = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), [], 0
    for k in np.split(order, np.flatnonzero(np.diff(piece)) + 1):
        base = np.cumsum(width[k]) - width[k]
        got, ioff = _solve(v, data[np.repeat(s[k] - base, width[k]) + np.arange(width[k].sum())], np.append(base, width[k].sum()))
        first[k], reps[k] = ioff[:-1] + done, np.diff(ioff)
        ids.append(got)
        done += len(got)
    ids, first, reps = np.concatenate(ids), first[where], reps[where]
    if len(own) and v.byte_ids[_OWN] >= 0:
        ids[ids == v.byte_ids[_OWN]] = v.byte_ids[MARK[0]]
    out_base = np.cumsum(reps) - reps
    out = ids[np.repeat(first - out_base, reps) + np.arange(reps.sum())]
    at = np.searchsorted(cut, total)
    return out, np.append(out_base, reps.sum())[at]


def decode(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> pa.Array:
    """Texts of id lists: byte pieces become their bytes, markers spaces, the first marker goes, control pieces vanish.

    Bytes that are no UTF-8 become replacement characters; an id outside the vocabulary, or the unknown piece, becomes ' ⁇ '.
    """
    surface = [p.replace(MARK, b" ") for p in v.pieces]
    for c in v.control:
        surface[c] = b""
    unk = " ⁇ ".encode()
    surface[v.unk] = unk
    surface.append(unk)
    surface += [p[1:] if p[:1] == b" " else p for p in surface]  # as the first piece of a text
    pick = np.where((ids < 0) | (ids >= len(v.pieces)), len(v.pieces), ids)
    seen = np.flatnonzero(~np.isin(pick, v.control))
    at = np.searchsorted(seen, off[:-1])
    first = np.append(seen, len(pick))[at]
    first = first[first < off[1:]]
    pick[first] += len(v.pieces) + 1
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(surface, pa.large_binary()).take(pa.array(pick))), pa.scalar(b"", pa.large_binary()))
    try:
        return joined.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.large_string())


@functools.lru_cache(2)
def _cached(path: str) -> Vocabulary:
    return load(path)


def tokenize(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded): every document encoded, and decoded again from its ids.

    A null text gives null ids, 0 tokens and a null decoded text; an empty text gives no ids and an empty text. The
    decoded text equals the text. Whole texts of any length are encoded; repeated rows each get their row; other columns
    are ignored. Map side only, without a shuffle. The model file is read on the driver and broadcast: its size does not
    depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_cached(model_path))

    def run(batches):
        v = shared.value
        for b in X.slices(batches, "text"):
            arr = b.column(1)
            ids, off = encode(v, arr)
            null = arr.is_null()
            decoded = decode(v, ids, off)
            gone = np.asarray(null)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), pa.int32(), mask=np.append(gone, False)) if gone.any() else pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists, pa.array(np.diff(off).astype(np.int64)), pc.if_else(null, pa.scalar(None, pa.string()), decoded.cast(pa.string()))],
                ["doc_id", "ids", "n_tokens", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(X.lean(run), "doc_id long, ids array<int>, n_tokens long, decoded string")
