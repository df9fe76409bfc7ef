"""Language identification by word-first backoff.

A word that training has seen scores its per-language log frequency. An unseen word falls back to its character
n-grams, the longest length first: the first length of which at least half of the word's n-grams are known decides.
A word that no length covers says nothing about the language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

RESULT = "doc_id long, lang string, confidence double, known double, n_words long, keep boolean"
#: Letters of an n-gram from which it makes a word known.
SURE = 3
_TOP = 0x110000
_SEED = np.random.default_rng(7).integers(1, 2**63, _TOP, dtype=np.uint64) | np.uint64(1)
_tables: list[np.ndarray] = []


def _chars() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower-case form."""
    if not _tables:
        letter, lower = np.zeros(_TOP, bool), np.arange(_TOP, dtype=np.uint32)
        for c in range(0x30000):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                if len(s.lower()) == 1:
                    lower[c] = ord(s.lower())
        _tables.extend((letter, lower))
    return _tables[0], _tables[1]


@dataclass
class Model:
    """Sorted hash tables: words and, for each n, n-grams, each with a row of log probabilities by language."""

    langs: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]


def _code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cps, lead[off]


def _letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points; start and end of each run of letters; where each text's runs start."""
    letter, lower = _chars()
    cps, at = _code_points(data, off)
    n = len(cps)
    inside = np.zeros(n + 1, bool)
    inside[:n] = letter[cps]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    edge = at[(at > 0) & (at < n)]
    first[edge] = inside[edge]
    last = inside[:n] & ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return lower[cps], start, end, np.searchsorted(start, at)


def _hash(cps: np.ndarray) -> np.ndarray:
    p, _ = X._pow(len(cps) + 1)
    run = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(_SEED[cps] * p[: len(cps)], out=run[1:])
    return run


def _lookup(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, scores = table
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


def _grams(word_cps: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside words laid end to end; the word of each."""
    total = len(word_cps)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(length)), length)
    ok = owner[: total - n + 1] == owner[n - 1 :]
    at = np.flatnonzero(ok)
    return X.span_hash(_hash(word_cps), at, at + n), owner[at]


def fit(docs: DataFrame, max_docs_per_lang: int = 1000, min_count: int = 2, n_max: int = 5, seed: int = 11) -> Model:
    """Train on a bounded sample of labelled rows: about max_docs_per_lang documents of each language, whose words come to
    the driver with their counts. A word or n-gram that occurs fewer than min_count times in the sample is not learned: one
    occurrence can't tell a language from a slip. Rows with a null text or language are not used. No usable row gives a
    model without languages, under which every document is undecided.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    share = {r["lang"]: min(1.0, max_docs_per_lang / r["n"]) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model([], (np.zeros(0, np.uint64), np.zeros((0, 0))), {})
    pick = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counts = usable.filter(unit < pick[F.col("lang")]).select("lang", word.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    return _model(langs, rows.column("lang").to_pylist(), rows.column("word").to_pylist(), np.array(rows.column("n").to_pylist(), float), n_max, min_count)


def _model(langs: list[str], lang: list[str], word: list[str], n: np.ndarray, n_max: int, min_count: int = 2) -> Model:
    code = {x: k for k, x in enumerate(langs)}
    who = np.array([code[x] for x in lang], np.int64)
    data = "".join(word).encode("utf-32-le")
    cps, length = np.frombuffer(data, np.uint32), np.array([len(x) for x in word], np.int64)
    end = np.cumsum(length)

    def table(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(h, return_inverse=True)
        c = np.zeros((len(keys), len(langs)))
        np.add.at(c, (at, who[owner]), n[owner])
        used = c.sum(1) >= min_count
        keys, c = keys[used], c[used]
        return keys, np.log((c + 0.1) / (c.sum(0) + 0.1 * max(1, len(keys))))

    words = table(X.span_hash(_hash(cps), end - length, end), np.arange(len(word))) if len(word) else (np.zeros(0, np.uint64), np.zeros((0, len(langs))))
    return Model(langs, words, {k: table(*_grams(cps, length, k)) for k in range(1, n_max + 1)} if len(word) else {})


def score(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: summed log scores by language, number of words, number of known words: those that were scored as words or
    by n-grams of at least SURE letters. Shorter n-grams fit words of almost any language in the same script."""
    cps, start, end, bounds = _letter_runs(data, off)
    n_docs, n_lang = len(off) - 1, len(model.langs)
    n_words = np.diff(bounds)
    if not len(start) or not n_lang:
        return np.zeros((n_docs, n_lang)), n_words, np.zeros(n_docs, np.int64)
    h = X.span_hash(_hash(cps), start, end)
    distinct, example, back = np.unique(h, return_index=True, return_inverse=True)
    scores, done, sure = np.zeros((len(distinct), n_lang)), np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    hit, at = _lookup(model.words, distinct)
    scores[hit], done[hit], sure[hit] = model.words[1][at[hit]], True, True
    for n in sorted(model.grams, reverse=True):
        left = np.flatnonzero(~done)
        if not len(left):
            break
        s, e = start[example[left]], end[example[left]]
        length = e - s
        fit_ = length >= n
        left, s, length = left[fit_], s[fit_], length[fit_]
        if not len(left):
            continue
        base = np.cumsum(length) - length
        flat = cps[np.repeat(s - base, length) + np.arange(length.sum())]
        g, owner = _grams(flat, length, n)
        known, at = _lookup(model.grams[n], g)
        share = np.bincount(owner[known], minlength=len(left))
        covered = 2 * share >= length - n + 1
        for k in range(n_lang):
            v = np.bincount(owner[known], weights=model.grams[n][1][at[known], k], minlength=len(left))
            scores[left[covered], k] = v[covered] / share[covered]
        done[left[covered]] = True
        if n >= SURE:
            sure[left[covered]] = True
    out = np.zeros((n_docs, n_lang))
    doc = np.repeat(np.arange(n_docs), n_words)
    for k in range(n_lang):
        out[:, k] = np.bincount(doc, weights=scores[back, k], minlength=n_docs)
    return out, n_words, np.bincount(doc, weights=sure[back], minlength=n_docs).astype(np.int64)


def decide(model: Model, data: np.ndarray, off: np.ndarray, min_known: float, min_confidence: float) -> dict[str, np.ndarray]:
    s, n_words, n_known = score(model, data, off)
    known = n_known / np.maximum(1, n_words)
    if model.langs:
        best = s.argmax(1)
        odds = np.exp(np.minimum(0.0, s - s.max(1, keepdims=True)))
        confidence = np.where(n_known > 0, 1 / odds.sum(1), 0.0)
        lang = np.array(model.langs, object)[best]
    else:
        confidence, lang = np.zeros(len(n_words)), np.full(len(n_words), None, object)
    keep = (n_known > 0) & (known >= min_known) & (confidence >= min_confidence)
    lang = np.where(n_known > 0, lang, None)
    return {"lang": lang, "confidence": confidence, "known": known, "n_words": n_words, "keep": keep}


def identify(docs: DataFrame, model: Model, min_known: float = 0.3, min_confidence: float = 0.5) -> DataFrame:
    """One row for each document: predicted language, its posterior, the share of its words that are known, keep.

    keep is false, and the document is rejected, if less than min_known of its words are known, as in a language that
    training has not seen, or the best language's posterior is under min_confidence. A null or empty text, or one without
    letters, has a null language, 0 words and is rejected, as has one without any known word. Repeated rows each get their own row; other columns are ignored. Map
    side only: no shuffle, the model is the one broadcast and its size is bounded by the parameters of fit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in X.slices(batches, "text"):
            d = decide(shared.value, *X.buffers(b.column(1)), min_known, min_confidence)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(d["lang"], pa.string()), pa.array(d["confidence"]), pa.array(d["known"]), pa.array(d["n_words"].astype(np.int64)), pa.array(d["keep"])],
                ["doc_id", "lang", "confidence", "known", "n_words", "keep"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(X.lean(run), RESULT)


def keep_identified(docs: DataFrame, model: Model, min_known: float = 0.3, min_confidence: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that identify would keep. Columns of any name and type pass through.

    A null, empty or letterless text goes; repeated rows stay or go together; a null doc_id makes no difference. An empty
    table gives an empty one. Map side only, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in X.slices(batches, at):
            yield b.filter(pa.array(decide(shared.value, *X.buffers(b.column(at)), min_known, min_confidence)["keep"]))

    return docs.mapInArrow(X.lean(run), docs.schema)
