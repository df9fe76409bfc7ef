import base64
import collections
import gzip
import hashlib
import io
import itertools
import math
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest

from sparklode.llm import components, jaccard, langid, lines, mixing, neardup_vectors, quality, queries, sentencepiece, suffixes, topk, vectors, warc
from sparklode.llm import packed as P
from sparklode.llm import text as X

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts, extra=True):
    """texts: {id: text}; with columns whose names the operators use inside."""
    rows = [(k, t, None, f"s{(k or 0) % 3}", len(t) if t else None) for k, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("row", "key", "block", "n", "bucket", "blob", "cell", "__row", "__cut", "set", "copy", "starts", "finish", "ids", "kind", "n_deleted"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def hard_texts(rng):
    """Nulls, empty, blank and one-word texts, copies, near copies, long texts, shared passages, repeated lines."""
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rng, 60, 10**6)
    long = "\n".join(sentence(rng, 40, 10**6) for _ in range(300))
    few = "\n".join(["line one", "line two", "line three", "line four"])
    texts = [base, base, " ".join(near), base.upper(), None, "", "  \n ", "word", "word", "two words", passage + " " + sentence(rng, 30, 10**6), sentence(rng, 20, 10**6) + "\n" + passage, long, "start\n" + long, few, "x\n" + few + "\ny", "a\na\na\na\na\na", "ends\nin\nnewline\n", "ends\nin\nnewline\n", " ".join(["same"] * 200), "é ü 日本 " * 30]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def hard(spark):
    texts = hard_texts(random.Random(3))
    return texts, table(spark, texts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_lines_of_whole_batches():
    texts = ["a b", "", " c\n", "d\n\ne", "\n", "x"]
    data, off = X.buffers(pa.array(texts))
    s, e, b = X.words(data, off)
    raw = data.tobytes()
    assert [raw[i:j].decode() for i, j in zip(s, e)] == ["a", "b", "c", "d", "e", "x"] and b.tolist() == [0, 2, 2, 3, 5, 5, 6]
    s, e, b = lines.line_spans(data, off)
    got = [[raw[s[i] : e[i]].decode() for i in range(b[k], b[k + 1])] for k in range(len(texts))]
    assert got == [t.split("\n") if t else [] for t in texts]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 50, 0, 1, 500, 2)]})
    parts = list(X.slices(iter([batch]), "text", 60))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and max(p.num_rows for p in parts) < 6


# 1


def test_trie_holds_its_keys_and_no_others():
    keys = [b"a", b"ab", b"abc", b"b", "é".encode(), b"\xff\xfe", b"zzz"]
    base, check, value = sentencepiece.double_array(keys, list(range(7)))

    def get(k):
        s = 0
        for c in k:
            t = base[s] + c
            if base[s] <= 0 or t >= len(check) or check[t] != s:
                return -1
            s = t
        return value[s]

    assert [get(k) for k in keys] == list(range(7)) and all(get(k) == -1 for k in (b"", b"c", b"abcd", b"zz", b"\xff"))


def unigram(pieces):
    names = [b"<unk>"] + [f"<0x{k:02X}>".encode() for k in range(256)] + [p.encode() for p in pieces]
    return sentencepiece.build(names, np.array([0.0] * 257 + list(pieces.values())), [2] + [6] * 256 + [1] * len(pieces))


def test_viterbi_is_the_best_segmentation():
    m = "▁"
    pieces = {m: -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -4.0, m + "a": -3.5, m + "ab": -4.2, "aba": -5.0, m + m: -5.5}
    v = unigram(pieces)

    def best(t):
        marked = (m + t.replace(" ", m)) if t else ""
        score = [0.0] + [-math.inf] * len(marked)
        for j in range(1, len(marked) + 1):
            for i in range(j):
                if marked[i:j] in pieces:
                    score[j] = max(score[j], score[i] + pieces[marked[i:j]])
                elif j == i + 1 and marked[i:j] not in pieces:
                    score[j] = max(score[j], score[i] + v.unk_score)
        return score[-1]

    rng = random.Random(0)
    texts = ["".join(rng.choice("ab  ") for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["axb", "é a"]
    ids, off = sentencepiece.encode(v, pa.array(texts))
    for k, t in enumerate(texts):
        mine = ids[off[k] : off[k + 1]]
        got = sum(v.scores[i] for i in mine if i > 256) + v.unk_score * sum(1 for c in t if c not in "ab ")
        assert abs(got - best(t)) < 1e-9, t
    assert sentencepiece.decode(v, ids, off).to_pylist() == texts


def test_tokenize_round_trip(spark, hard):
    texts, df = hard
    got = {r.doc_id: r for r in sentencepiece.tokenize(df, MODEL).collect()}
    for k, t in texts:
        assert got[k].decoded == t and (got[k].ids is None) == (t is None) and got[k].n_tokens == len(got[k].ids or [])
    odd = ["▁ a\x00b\r\n\t  c 😀", "▁", "▁▁ ▁x▁y ▁", "x▁y", "▀▂ ▁", " ▁", "x" * 300_000, "y"]
    df = spark.createDataFrame([(None if t == "y" else 1, t) for t in odd], "doc_id long, text string")
    assert sorted(r.decoded for r in sentencepiece.tokenize(df, MODEL).collect()) == sorted(odd)
    assert sentencepiece.tokenize(empty(spark), MODEL).count() == 0


def test_decoding_odd_ids():
    v = sentencepiece.load(MODEL)
    ids = np.array([1, v.byte_ids[0xFF], 10**9, 2])
    assert sentencepiece.decode(v, ids, np.array([0, 2, 3, 4])).to_pylist() == ["�", " ⁇ "[1:] and "⁇ ", ""]


# 2


def test_mixture_is_fair_queueing(spark):
    rng = random.Random(2)
    docs = [(k, rng.choice(["a", "a", "a", "b", None]), sentence(rng, rng.randint(0, 30))) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = [tuple(r) for r in mixing.schedule(df, {"a": 2.0, "b": 0.5}, budget_share=0.6).orderBy("total_tokens", "finish", "source").collect()]
    want = brute.mix(docs, {"a": 2.0, "b": 0.5}, 0.6)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = {r.doc_id for r in mixing.mix(df, {"a": 2.0, "b": 0.5}, budget_share=0.6).collect()}
    assert kept == {w[0] for w in want}


def test_mixture_edges(spark, hard):
    texts, df = hard
    kept = mixing.mix(df, {}, budget_share=1.0)
    assert kept.columns == df.columns and kept.count() == df.count()
    twice = df.unionByName(df)
    ids = [r.doc_id for r in mixing.mix(twice, {"s1": 0.0}, budget_share=0.7).collect()]
    assert len(ids) == 2 * len(set(ids)) and all(k % 3 != 1 for k in ids)
    assert mixing.schedule(df, {}, budget_tokens=0).agg({"n_tokens": "sum"}).first()[0] in (None, 0)
    assert mixing.mix(empty(spark), {"s": 1.0}).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, "a", "x y")], "doc_id long, source string, text string")
    assert mixing.mix(nulls, {}, budget_share=1.0).count() == 2


# 3


def linked(df):
    return {r[0]: (r.class_id, r.n_links) for r in df.collect()}


def near_texts(rng, n, words_, vocabulary):
    texts = []
    for _ in range(n):
        base = sentence(rng, rng.randint(1, words_), vocabulary).split()
        for _ in range(rng.randint(1, 5)):
            w = [x if rng.random() > 0.04 else "z" for x in base]
            texts.append(" ".join(w[: rng.randint(len(w) - len(w) // 10, len(w))]))
    return texts


@pytest.mark.parametrize("t", [0.5, 0.7])
def test_jaccard_equals_brute_force(spark, hard, t):
    texts = list(enumerate([x for _, x in hard[0]] + near_texts(random.Random(4), 40, 60, 60)))
    want = brute.classes(dict(texts), brute.jaccard_pairs(dict(texts), t))
    assert linked(jaccard.links(table(spark, texts), t)) == want
    kept = jaccard.keep_one(table(spark, texts), t)
    assert {r.doc_id for r in kept.collect()} == brute.keep_one(dict(texts), t)


def test_jaccard_edges(spark, hard):
    _, df = hard
    assert jaccard.links(empty(spark)).count() == 0 and jaccard.keep_one(empty(spark)).count() == 0
    t = spark.createDataFrame([(None, "a b c d"), (None, "x"), (5, "a b c d"), (5, "a b c d"), (6, None), (7, ""), (8, "A B  c\nd"), (9, "p q r"), (9, "a b c d"), (10, "p q r")], "doc_id long, text string")
    assert linked(jaccard.links(t)) == {None: (None, 0), 5: (5, 2), 6: (6, 0), 7: (7, 0), 8: (5, 2), 9: (5, 3), 10: (9, 1)}
    assert sorted((r.doc_id or 0) for r in jaccard.keep_one(t).collect()) == [0, 0, 6, 7, 9]
    assert jaccard.keep_one(df).columns == df.columns


def test_jaccard_ways_of_large_inputs(spark, hard, monkeypatch):
    """Hot tokens, split tokens and blocks, and shuffled joins give the same rows."""
    from sparklode.llm import blocks

    texts = list(enumerate([x for _, x in hard[0]] + near_texts(random.Random(5), 30, 40, 30)))
    df, want = table(spark, texts), brute.classes(dict(texts), brute.jaccard_pairs(dict(texts), 0.5))
    for name, value in (("BROADCAST_ROWS", 0), ("BLOCK_SETS", 2), ("GROUP", 2), ("HOT_LEAST", 2), ("HOT_SHARE", 0.0)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 0)
    assert linked(jaccard.links(df)) == want
    monkeypatch.setattr(jaccard, "HOT_TOKENS", 3)
    assert linked(jaccard.links(df)) == want


def test_many_short_texts_in_one_batch(spark):
    texts = [(k, f"a{k} b{k} c{k}") for k in range(70_000)] + [(70_000, "a1 b1 c1"), (70_001, "a69999 b69999 c69999")]
    df = spark.createDataFrame(pa.Table.from_pydict({"doc_id": [k for k, _ in texts], "text": [t for _, t in texts]})).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        got = linked(jaccard.links(df).filter("n_links > 0"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {1: (1, 1), 70_000: (1, 1), 69_999: (69_999, 1), 70_001: (69_999, 1)}


def test_near_texts_longer_than_a_slice(spark):
    rng = random.Random(11)
    long = sentence(rng, 400_000, 10**6)
    assert len(long) > 1.5 * jaccard._SLICE
    near = long.split()
    near[7] = "changed"
    df = table(spark, [(0, long), (1, " ".join(near)), (2, "short text here")], False)
    assert linked(jaccard.links(df)) == {0: (0, 1), 1: (0, 1), 2: (2, 0)}


def test_large_groups_of_copies_and_near_copies(spark):
    rng = random.Random(9)
    base = sentence(rng, 80).split()
    texts = []
    for k in range(150):
        w = list(base)
        w[k % 40] = f"new{k % 75}"
        texts.append((k, " ".join(w)))
    got = linked(jaccard.links(table(spark, texts, False), 0.7))
    assert got == brute.classes(dict(texts), brute.jaccard_pairs(dict(texts), 0.7))


def test_op3_finds_copies_with_a_tenth_of_the_words_changed(spark, tmp_path):
    rng = random.Random(10)
    texts, planted = [], set()
    for changed in (3, 4, 5, 6, 6, 6):
        base = sentence(rng, 60, 10**6).split()
        near = list(base)
        for k in range(changed):
            near[4 + k * (54 // changed)] = f"new{k}"
        planted.add((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(near)]
    texts = list(enumerate(texts))
    table(spark, texts, False).write.parquet(str(tmp_path / "documents.parquet"))
    assert planted == brute.jaccard_pairs(dict(texts), 0.5).keys()
    assert linked(queries.op3_jaccard(spark, str(tmp_path))) == brute.classes(dict(texts), planted)


def test_components(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (200, 200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)]
    df = spark.createDataFrame(edges + [(None, 5), (6, None)], "u long, v long").repartition(4)
    want = {k: r for k, (r, _) in brute.classes({x for e in edges for x in e}, edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.root for r in components.components(df).collect()} == want
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert {r.node: r.root for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_six_byte_tokens():
    t = np.array([0, 1, (1 << 48) - 1, 123456789012345], np.uint64)
    assert (P.unsix(P.six(t)) == t).all()
    a, b, c = P.unpack(P.pack(t, b"xyz", np.arange(3, dtype="<u4")), "<u8", None, "<u4")
    assert (a == t).all() and bytes(b) == b"xyz" and c.tolist() == [0, 1, 2]


# 4


def test_warc_round_trip(spark):
    big = "é" * 100_000
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, None), (None, "http://b/\r\nX: y", ""), (3, "u", big), (1, "http://a/", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS record_id")
    got = warc.roundtrip(df, 1000).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.record_id, r.chunk_no)):
        by.setdefault(r.record_id, []).append(r)
    body = b"".join(base64.b64decode(r.payload) for r in by["<urn:page:3>"])
    assert body == big.encode() and [r.offset for r in by["<urn:page:3>"]] == list(range(0, 200_000, 1000))
    assert by["<urn:page:3>"][-1].last and all(r.n_bytes <= 1000 for r in got)
    assert by["<urn:page:3>"][4].sha1 == hashlib.sha1(big.encode()[:5000]).hexdigest()
    assert len(by["<urn:page:1>"]) == 2 and by["<urn:page:2>"][0].n_bytes == 0 and by["<urn:page:>"][0].uri == "http://b/X: y"
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_warc_files_of_others():
    def record(kind, body, extra=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n{extra}\r\n".encode() + body + b"\r\n\r\n"

    plain = record("warcinfo", b"software: x") + record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http\r\n") + record("resource", b"")
    got = list(warc.records(io.BytesIO(plain), 4))
    assert [r[1] for r in got if r[4] == 0] == ["warcinfo", "request", "resource"] and b"".join(r[6] for r in got if r[1] == "warcinfo") == b"software: x"
    whole = list(warc.records(io.BytesIO(gzip.compress(plain)), 4))
    assert whole == got
    for cut in (plain[:70], gzip.compress(plain)[:-20]):
        with pytest.raises((ValueError, EOFError)):
            list(warc.records(io.BytesIO(cut), 4))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"nothing"), 4))
    assert list(warc.records(io.BytesIO(b""), 4)) == []


def test_warc_http_blocks_without_a_whole_header():
    def got(body, kind="application/http; msgtype=response"):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        rows = list(warc.records(io.BytesIO(head + body + b"\r\n\r\n" + head + body), 10))
        assert all(len(r[6]) <= 10 for r in rows) and sum(r[4] == 0 for r in rows) == 2
        mine = rows[: len(rows) // 2]
        assert mine[-1][7] == hashlib.sha1(b"".join(r[6] for r in mine)).hexdigest() and [r[8] for r in mine] == [False] * (len(mine) - 1) + [True]
        return mine[0][3], b"".join(r[6] for r in mine)

    assert got(b"") == (None, b"")
    for body in (b"HTTP/1.1 200 OK", b"HTTP/1.1 200 OK\r\nA: b\r\n", b"x" * 50, b"x" * (warc._HEAD + 30)):
        assert got(body) == (None, body)
    assert got(b"HTTP/1.1 404 No\r\n\r\nbody") == (404, b"body") and got(b"HTTP/1.1 200\r\n\r\n") == (200, b"") and got(b"HTTP/1.1 200\r\n\r\n", "text/html") == (None, b"HTTP/1.1 200\r\n\r\n")
    for bad in (b"WARC/1.1\r\nContent-Length: -1\r\n\r\n", b"WARC/1.1\r\nA: b\r\n\r\n", b"WARC/1.1\r\nContent-Length: 0\r\n", b"WARC/1.1" + b"x" * (2 * warc._HEAD)):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad), 10))


# 5


@pytest.mark.parametrize("letters,shallow", [(2, 1), (3, 4), (50, 8), (5, 30)])
def test_deep_shallow_sorts(letters, shallow):
    rng = np.random.default_rng(letters)
    w = rng.integers(1, letters + 1, 400).astype(np.uint32)
    w[100:180] = w[:80]
    w[200:280] = w[:80]
    w[250] += 1
    order, lcp = suffixes.deep_shallow(w, np.arange(370), 30, shallow)
    keys = [tuple(w[i : i + 30].tolist()) for i in range(370)]
    assert [keys[i] for i in order] == sorted(keys)
    for i in range(1, 370):
        a, b = keys[order[i - 1]], keys[order[i]]
        assert lcp[i] == next((k for k in range(30) if a[k] != b[k]), 30)


def test_repeats_equal_brute_force(spark, hard):
    texts, df = hard
    got = {tuple(r) for r in suffixes.repeats(df, min_words=20, gram=6).select("doc_id", "kind", "start_word", "end_word").collect()}
    assert got == brute.repeats(dict(texts), 20)
    assert any(k == 10 for k, *_ in got) and any(k == 11 for k, *_ in got)


def test_repeats_edges(spark):
    assert suffixes.repeats(empty(spark)).count() == 0
    rng = random.Random(1)
    passage = sentence(rng, 50, 10**6)
    t = spark.createDataFrame([(None, passage), (1, "a " + passage), (2, passage), (2, passage), (3, passage[: passage.rindex(" ")]), (4, None), (5, "")], "doc_id long, text string")
    assert {tuple(r) for r in suffixes.repeats(t).collect()} == {(1, "repeated", 1, 51), (2, "repeated", 0, 50), (2, "later", 0, 50)}


# 6


def brute_topk(rows, k, every=1):
    """{query: a sorted list of (neighbour, distance) lists, one for each time that it occurs}."""
    out = {}
    for i, x in rows:
        if i % every == 0:
            d = sorted((math.dist(x, y), j) for j, y in rows if j != i)
            out.setdefault(i, []).append([(j, v) for v, j in d[:k]])
    return out


def found_topk(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {}).setdefault(r["rank"], []).append((r.neighbour, r.distance))
    return {i: [[v[n][c] for n in sorted(v)] for c in range(len(v[1]))] for i, v in out.items()}


def same_topk(got, want):
    names = lambda t: {i: [[j for j, _ in c] for c in v] for i, v in t.items()}
    return names(got) == names(want) and all(abs(g[1] - w[1]) < 2e-6 for i in want for a, b in zip(got[i], want[i]) for g, w in zip(a, b))


@pytest.mark.parametrize("d,block,every", [(16, 32, 1), (7, 50, 3), (1, 20, 1), (64, 16, 20)])
def test_topk_equals_brute_force(spark, d, block, every):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(6, d)) * 5
    x = (centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, d)) * 0.1).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert same_topk(found_topk(topk.nearest(df, 5, every, block, block // 2)), brute_topk(rows, 5, every))


def test_topk_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "_GROUP", 3)
    rows = [(1, [1.0, 2.0])] * 8 + [(2, [1.0, 2.5])] + [(3, [9.0, 9.0])] * 5
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert same_topk(found_topk(topk.nearest(df, 20, 1, 2, 2)), brute_topk(rows, 20))


def test_topk_compares_survivors_only():
    rng = np.random.default_rng(3)
    x = np.repeat(np.linspace(0, 100, 50), 40)[:, None] + rng.normal(size=(2000, 32)) * 0.01
    best = topk._Best(np.arange(2000), x, 5)
    best.meet(np.arange(2000), x)
    assert best.compared < 2000 * 60


def test_segment_statistics_bound_distances():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 30)), rng.normal(size=(50, 30))
    true = ((x[:, None] - y[None]) ** 2).sum(2)
    last = np.zeros_like(true)
    for n in (2, 6, 30):
        bound = topk._sq(topk.statistics(x, n), topk.statistics(y, n))
        assert (bound <= true + 1e-9).all() and bound.mean() >= last.mean()
        last = bound


ODD = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 0.0]), (9, [None, 1.0])]


def test_vectors_that_take_no_part(spark):
    t = spark.createDataFrame(ODD, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "1 AS cell", "2 AS id")
    rows, d = vectors.usable(t)
    assert d == 2 and {r.vec_id for r in rows.collect()} == {1, 2, 8}
    assert [(r.vec_id, r.neighbour) for r in topk.nearest(t, 1).orderBy("vec_id").collect()] == [(1, 2), (2, 1), (8, 1)]
    assert linked(neardup_vectors.links(t)) == {None: (None, 0), 1: (1, 1), 2: (1, 1), **{k: (k, 0) for k in range(3, 10)}}
    assert topk.nearest(t.limit(0)).count() == 0 and neardup_vectors.links(t.limit(0)).count() == 0
    one = t.filter("vec_id = 1")
    assert topk.nearest(one).count() == 0 and topk.nearest(one.unionByName(one), every=2).count() == 0 and topk.nearest(one.unionByName(one)).count() == 0 and linked(neardup_vectors.links(one.unionByName(one))) == {1: (1, 0)}


# 7


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    got = langid.identify(docs.filter("doc_id % 2 = 1"), model).join(docs.selectExpr("doc_id", "lang AS truth"), "doc_id").collect()
    assert sum(r.lang == r.truth for r in got) >= 0.97 * len(got) and all(r.keep for r in got if r.n_words > 20)


def test_backoff_from_words_to_shorter_grams():
    words = {"a": ["aaaa", "abab"], "b": ["xyxyz", "zzzz"]}
    model = langid._model(["a", "b"], [k for k, v in words.items() for _ in v], [w for v in words.values() for w in v], np.full(4, 10.0), 5)
    d = langid.decide(model, *X.buffers(pa.array(["aaaa", "aaab", "zzzy zzzzz", "QQQ 12", "", None])), 0.3, 0.5)
    assert d["lang"].tolist() == ["a", "a", "b", None, None, None] and d["keep"].tolist() == [True, True, True, False, False, False]
    assert d["n_words"].tolist() == [1, 1, 2, 1, 0, 0]


def test_language_scores_equal_brute_force():
    rng = random.Random(7)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    counts = collections.Counter()
    for lang, letters in (("a", "abcdé"), ("b", "cdefg"), ("c", "xyzß")):
        for _ in range(150):
            counts[lang, make(letters)] += rng.randint(1, 3)
    model = langid._model(["a", "b", "c"], [k for k, _ in counts], [w for _, w in counts], np.array(list(counts.values()), float), 5)
    texts = [" ".join(make(rng.choice(["abcdé", "cdefg", "xyzß", "abcxyz", "ABCdE", "qrs"])) for _ in range(rng.randint(0, 12))) + rng.choice(["", " 12, x.", "!"]) for _ in range(120)]
    scores, n, sure = langid.score(model, *X.buffers(pa.array(texts)))
    decided = langid.decide(model, *X.buffers(pa.array(texts)), 0.3, 0.5)
    for k, t in enumerate(texts):
        want, found, known = brute.language(counts, t)
        assert (n[k], sure[k]) == (found, known) and np.allclose(scores[k], [want[x] for x in "abc"])
        top = max(want.values())
        confidence = 1 / sum(math.exp(v - top) for v in want.values())
        assert decided["keep"][k] == (known > 0 and known >= 0.3 * found and confidence >= 0.5)


def test_language_model_counts_its_sample(spark):
    docs = spark.createDataFrame([(k, "Ab ab, cd cd once%d" % k, "x") for k in range(5)] + [(9, None, "x"), (10, "ef ef", None)], "doc_id long, text string, lang string")
    model, known = langid.fit(docs), langid._model(["x"], ["x"] * 7, ["ab", "cd"] + ["once"] * 5, np.array([10.0, 10, 1, 1, 1, 1, 1]), 5)
    assert model.langs == ["x"] and (model.words[0] == known.words[0]).all() and np.allclose(model.words[1], known.words[1])


def test_unseen_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(0)
    strange = [" ".join("".join(rng.choice("qxzjkvwy") for _ in range(rng.randint(4, 9))) for _ in range(50)), "Ὅμηρος ἔγραψε τὴν Ἰλιάδα καὶ τὴν Ὀδύσσειαν", "漢字 仮名 交じり 文"]
    assert not langid.decide(model, *X.buffers(pa.array(strange)), 0.3, 0.5)["keep"].any()


def test_language_edges(spark, hard):
    texts, df = hard
    model = langid.fit(df)
    assert model.langs == [] and langid.keep_identified(df, model).count() == 0
    trained = langid.fit(df.selectExpr("doc_id", "text", "'en' AS lang"))
    kept = langid.keep_identified(df, trained)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in langid.identify(df, trained).collect() if r.keep}
    assert langid.identify(empty(spark), trained).count() == 0 and langid.keep_identified(empty(spark), langid.fit(empty(spark))).count() == 0


# 8


def test_line_dedup_equals_brute_force(spark, hard):
    rng = random.Random(8)
    texts = [t for _, t in hard[0]] + ["\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts = list(enumerate(texts))
    got = {r.doc_id: r.text for r in lines.dedup(table(spark, texts)).collect()}
    assert got == brute.line_dedup(dict(texts))
    docs = lines.dedup_documents(table(spark, texts))
    assert docs.columns == table(spark, texts).columns
    for r in docs.collect():
        assert r.text == got[r.doc_id] and (not r.text or r.n_chars == len(r.text))
    gone = {k for k, _ in texts} - {r.doc_id for r in docs.collect()}
    assert gone and all(not got[k].strip() for k in gone)


def test_line_dedup_edges(spark):
    run = "a\nb\nc"
    t = spark.createDataFrame([(None, run), (1, run), (1, run), (2, "a\nb"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text, r.n_deleted) for r in lines.dedup(t).collect() if r.text is not None)
    assert got == [(0, run, 0), (1, "", 3), (1, "", 3), (2, "a\nb", 0), (4, "", 0)]
    assert lines.dedup(empty(spark)).count() == 0 and lines.dedup_documents(empty(spark)).columns == empty(spark).columns


def test_long_runs_of_few_lines_go(spark, hard):
    rng = random.Random(12)
    pool = [sentence(rng, n) for n in (1, 2, 9, 12, 20, 30)]
    texts = [t for _, t in hard[0]] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    want, seen = {}, set()
    for k, t in enumerate(texts):
        parts, dead = (t or "").split("\n"), set()
        for i, n in itertools.product(range(len(parts)), (1, 2, 3)):
            run = tuple(parts[i : i + n])
            if t and len(run) == n and (n == 3 or len(brute.words("\n".join(run))) >= 20):
                dead |= set(range(i, i + n)) if run in seen else set()
                seen.add(run)
        want[k] = "\n".join(p for i, p in enumerate(parts) if i not in dead) if t else t
    df = table(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.text, r.n_deleted) for r in lines.dedup(df, min_words=20).collect()}
    assert {k: t for k, (t, _) in got.items()} == want and got[1] == ("", 1)
    kept = {r.doc_id: r.text for r in lines.dedup_documents(df, min_words=20).collect()}
    assert kept == {k: t for k, t in want.items() if t == texts[k] or t.strip()}
    assert lines.dedup(empty(spark), min_words=20).count() == 0


def test_pipeline_deletes_long_single_lines(spark):
    import corpus_pipeline as C

    rng = random.Random(13)
    long = sentence(rng, 60, 10**6)
    docs = table(spark, [(0, "a\n" + long), (1, "b\n" + long + "\nOf."), (2, "c\nOf."), (3, long)], False)
    assert {r.doc_id: r.text for r in C.line_dedup(spark, docs, "").collect()} == {0: "a\n" + long, 1: "b\nOf.", 2: "c\nOf."}


def test_shuffled_deletions(spark, hard, monkeypatch):
    texts, df = hard
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == brute.line_dedup(dict(texts))


def test_texts_longer_than_a_slice(spark):
    """Texts of more than 2 MB, beside short ones: nothing is cut off."""
    rng = random.Random(14)
    long = "\n".join(sentence(rng, 12, 10**6) for _ in range(30_000))
    passage = "\n".join(long.split("\n")[-10:-2])
    texts = {0: long, 1: "short one", 2: "first\n" + passage + "\nlast", 3: long + "\nend"}
    assert len(long) > 2_200_000
    df = table(spark, list(texts.items()), False)
    assert {r.doc_id: r.decoded for r in sentencepiece.tokenize(df, MODEL).collect()} == texts
    model = langid.fit(df.selectExpr("doc_id", "text", "'en' AS lang"))
    assert {r.doc_id: r.n_words for r in langid.identify(df, model).collect()} == {k: len(re.findall("[a-zA-Z]+", t)) for k, t in texts.items()}
    assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == brute.line_dedup(texts)
    n = 12 * 30_000
    spans = {tuple(r) for r in suffixes.repeats(df).select("doc_id", "kind", "start_word", "end_word").collect()}
    assert spans == {(0, "repeated", 0, n), (2, "repeated", 1, 97), (2, "later", 1, 97), (3, "repeated", 0, n), (3, "later", 0, n)}
    scored = {r.doc_id: r.score for r in quality.classify(df, quality.fit(df, spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int"))).collect()}
    assert len(scored) == 4 and all(0 <= v <= 1 for v in scored.values())


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 4, 500).astype(np.uint64)
    bounds = np.array([0, 3, 10, 11, 300, 500])
    for w in (1, 2, 3, 5):
        at = set(lines.select(h, bounds, w).tolist())
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            for i in range(lo, hi - w + 1):
                m = min(h[i : i + w])
                assert max(k for k in range(i, i + w) if h[k] == m) in at


# 9


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.classify(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) >= 0.93 * len(got)


def test_document_statistics_equal_brute_force():
    rng = random.Random(15)
    texts = ["", None, "one", "One ONE one, two! 50% | a_b\n\nA line\nA line\n", "é ü 日本 x" * 9, "\n", "w" * 30 + " NASA end."] + ["".join(rng.choice("abC 1.,!|%#\n é") for _ in range(rng.randint(1, 80))) for _ in range(150)]
    got = quality.statistics(pa.array(texts))
    for row, t in zip(got, texts):
        raw, w = (t or "").encode(), [x.encode() for x in brute.words(t)]
        if not raw:
            assert not row.any()
            continue
        n, size, lines_ = max(1, len(w)), len(raw), raw.split(b"\n")
        lines_ = lines_[:-1] if raw.endswith(b"\n") else lines_
        share = lambda cs: sum(c in cs for c in raw) / size
        pairs = list(itertools.pairwise(w))
        upper = lambda x: sum(65 <= c <= 90 for c in x)
        want = [
            math.log1p(size), math.log1p(len(w)), sum(map(len, w)) / n, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), sum(c >= 128 for c in raw) / size, share(b"\n"), share(b"!"), share(b"|"), share(b"%"),
            share(b"#$&*@^~_=+<>/\\[]{}`"), share(b",."), len(set(w)) / n, max(collections.Counter(w).values(), default=0) / n, sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(1, len(w) - 1),
            size / len(lines_), 1 - len(set(lines_)) / len(lines_), sum(upper(x) >= max(2, len(x) / 2) for x in w) / n, sum(len(x) > 20 for x in w) / n,
        ]
        assert np.allclose(row, want), t


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x, y, trees=30)

    def walk(row):
        total = m.bias
        for k in m.roots:
            while m.left[k] != k:
                k = m.left[k] if row[m.feature[k]] <= m.cut[k] else m.right[k]
            total += m.value[k]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(m.predict(x), [walk(r) for r in x]) and ((m.predict(x) > 0.5) == y).mean() > 0.95


def test_quality_edges(spark, hard):
    texts, df = hard
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(df, none)
    got = {r.doc_id: r for r in quality.classify(df, model).collect()}
    assert len(got) == len(texts) and not got[4].keep and got[4].score == 0 and not got[5].keep
    odd = spark.createDataFrame([(0, None), (1, 1), (1, 0), (None, 1), (12, 0), (13, 0), (2, 1)], "doc_id long, quality int")
    assert np.isfinite(quality.fit(df, odd).predict(np.zeros((1, len(quality.FEATURES))))).all()
    assert quality.classify(empty(spark), model).count() == 0


# 10


def test_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    p = neardup_vectors.decode(x)
    whole = (p * 2 % 2 == 0).all(1)
    half = (p * 2 % 2 == 1).all(1)
    assert (whole | half).all() and (p.sum(1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    for v in neardup_vectors.SHORTEST:
        assert (d <= ((x - p - v) ** 2).sum(1) + 1e-9).all()
    assert len(neardup_vectors.SHORTEST) == 240 and np.allclose((neardup_vectors.SHORTEST**2).sum(1), 2)


def cosine_classes(x, t):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= t, 1)))}
    return pairs, brute.classes(range(len(x)), pairs)


def rotated(rng, n, d, cosine):
    x, r = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r -= (r * x).sum(1, keepdims=True) * x
    return x, cosine * x + math.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1, keepdims=True)


def vector_table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("d", [8, 16, 64])
def test_lattice_recall(spark, d):
    x, y = rotated(np.random.default_rng(d), 300, d, 0.955)
    both = np.concatenate([x, y, x[:40], x[:3]]).astype(np.float32)
    pairs, want = cosine_classes(both, 0.95)
    got = linked(neardup_vectors.links(vector_table(spark, both)))
    assert len(got) == len(want) and len(pairs) > 300 and all(got[i][1] <= want[i][1] for i in want)
    assert sum(n for _, n in got.values()) >= 0.95 * 2 * len(pairs)
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.95 * len(want)


@pytest.mark.parametrize("part", [1024, 8])
def test_clusters_of_copies_and_near_copies(spark, monkeypatch, part):
    """Hot cells: hundreds of close vectors and of equal ones; all links are found, whole cells or split."""
    from sparklode.llm import blocks

    monkeypatch.setattr(neardup_vectors, "PART", part)
    if part == 8:
        monkeypatch.setattr(blocks, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(3, 64))
    x = np.concatenate([np.repeat(centre[:1], 60, 0) + rng.normal(size=(60, 64)) * 0.02, np.repeat(centre[1:2], 50, 0), centre[2:] + rng.normal(size=(40, 64)) * 0.01, rng.normal(size=(30, 64))]).astype(np.float32)
    assert linked(neardup_vectors.links(vector_table(spark, x))) == cosine_classes(x, 0.95)[1]
