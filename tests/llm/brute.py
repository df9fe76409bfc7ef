"""Brute-force versions of the corpus operators, in plain Python."""

import collections
import hashlib
import math
import re

WORDS = re.compile("[^ \t\n\r]+")


def words(text):
    return WORDS.findall(text or "")


def line_dedup(docs, t=3):
    """docs: {key: text} in order -> {key: text without later runs of t lines}."""
    seen, out = set(), {}
    for key, text in docs.items():
        if not text:
            out[key] = text
            continue
        parts = text.split("\n")
        dead = set()
        for i in range(len(parts) - t + 1):
            run = tuple(parts[i : i + t])
            if run in seen:
                dead |= set(range(i, i + t))
            seen.add(run)
        out[key] = "\n".join(p for i, p in enumerate(parts) if i not in dead)
    return out


def grams(text, n=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_pairs(docs, t=0.7):
    sets = {k: grams(x) for k, x in docs.items()}
    keys = [k for k in sets if sets[k]]
    out = {}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= t:
                out[(min(a, b), max(a, b))] = j
    return out


def classes(keys, pairs):
    """{key: (least key of its class, number of links)}."""
    root, n = {k: k for k in keys}, collections.Counter(x for p in pairs for x in p)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: (find(k), n[k]) for k in keys}


def keep_one(docs, t=0.5):
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in jaccard_pairs(docs, t):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k for k in docs if find(k) == k}


def mix(docs, weights, share, seed=1):
    """docs: (doc_id, source, text) -> [(doc_id, source, tokens, finish, total)] of the mixture."""
    queues = collections.defaultdict(list)
    for doc, source, text in docs:
        queues[source].append((hashlib.md5(f"{seed}-{doc}".encode()).hexdigest(), doc, len(words(text))))
    rows = []
    for source, q in queues.items():
        done = 0
        for key, doc, n in sorted(q):
            done += n
            rows.append((done / weights.get(source, 1.0), source or "", key, doc, source, n))
    out, total = [], 0
    budget = int(sum(r[-1] for r in rows) * share)
    for finish, _, _, doc, source, n in sorted(rows):
        total += n
        if total > budget:
            break
        out.append((doc, source, n, finish, total))
    return out


def repeats(docs, w=50):
    seen = collections.defaultdict(list)
    for k in sorted(docs):
        x = words(docs[k])
        for i in range(len(x) - w + 1):
            seen[tuple(x[i : i + w])].append((k, i))
    marks = collections.defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for n, (k, i) in enumerate(sorted(places)):
                marks[k, "repeated"].update(range(i, i + w))
                if n:
                    marks[k, "later"].update(range(i, i + w))
    out = set()
    for (k, kind), m in marks.items():
        at = sorted(m)
        lo = prev = at[0]
        for q in [*at[1:], None]:
            if q != prev + 1:
                out.add((k, kind, lo, prev + 1))
                lo = q
            prev = q
    return out


def language(counts, text, n_max=5, min_count=2):
    """counts: {(lang, word): n} -> ({lang: score}, words, words that are known for sure) of a text, by the rule alone."""
    langs = sorted({lang for lang, _ in counts})

    def logs(pieces):
        total = collections.Counter()
        for (_, x), n in pieces.items():
            total[x] += n
        kept = {x for x, n in total.items() if n >= min_count}
        size = {lang: sum(n for (at, x), n in pieces.items() if at == lang and x in kept) + 0.1 * max(1, len(kept)) for lang in langs}
        return {x: {lang: math.log((pieces.get((lang, x), 0) + 0.1) / size[lang]) for lang in langs} for x in kept}

    words_ = logs(counts)
    grams = {}
    for n in range(1, n_max + 1):
        pieces = collections.Counter()
        for (lang, w), c in counts.items():
            for i in range(len(w) - n + 1):
                pieces[lang, w[i : i + n]] += c
        grams[n] = logs(pieces)
    score, found, sure = dict.fromkeys(langs, 0.0), 0, 0
    for w in "".join(c if c.isalpha() else " " for c in text or "").lower().split():
        found += 1
        if w in words_:
            sure += 1
            hits = [words_[w]]
        else:
            hits = []
            for n in range(min(n_max, len(w)), 0, -1):
                own = [w[i : i + n] for i in range(len(w) - n + 1)]
                known = [grams[n][g] for g in own if g in grams[n]]
                if 2 * len(known) >= len(own):
                    hits, sure = known, sure + (n >= 3)
                    break
        for lang in langs:
            score[lang] += sum(h[lang] for h in hits) / max(1, len(hits))
    return score, found, sure
