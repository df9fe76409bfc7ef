import os
import random
import sys

import brute
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents table with copies, near copies, shared lines, nulls and texts without a language."""
    rng = random.Random(6)
    vocabulary = {lang: [f"{a}{b}{c}" for a in s for b in s for c in s] for lang, s in (("en", ["the", "wh", "ing", "ou"]), ("de", ["sch", "ein", "ung", "ch"]))}
    rows, k = [], 0

    def text(lang, n):
        return "\n".join(" ".join(rng.choice(vocabulary[lang]) for _ in range(8)) for _ in range(n))

    for lang in vocabulary:
        for _ in range(30):
            body = text(lang, rng.randint(2, 8))
            copies = [body]
            if rng.random() < 0.3:
                copies.append(body)
            if rng.random() < 0.4:
                w = body.replace("\n", " ").split()
                w[len(w) // 2] = "changed"
                copies.append(" ".join(w))
            for t in copies:
                rows.append((k, t, lang, rng.choice(["src0", "src1", "src9"]), len(t)))
                k += 1
    rows += [(k, None, "en", "src0", None), (k + 1, "", None, None, 0), (k + 2, "12345 67 !!", "en", "src1", 11), (None, text("en", 4), "en", None, 5)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    return str(at)


def test_each_stage_on_what_the_one_before_kept(spark, folder):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for n, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, folder)
        at = f"{folder}/{n}.parquet"
        out.write.parquet(at)
        steps.append((name, docs.collect(), spark.read.parquet(at).collect()))
        if n < len(C.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.read.parquet(at)

    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    name, before, after = steps[0]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not r.text or r.text.startswith("1234")}

    _, before, after = steps[1]
    clean = brute.line_dedup({key(r): r.text for r in sorted(before, key=key)})
    assert {key(r): r.text for r in after} == {k: t for k, t in clean.items() if t.strip()}

    _, before, after = steps[2]
    assert {key(r) for r in after} == brute.keep_one({key(r): r.text for r in before})
    assert len(after) < len(before)

    _, before, after = steps[3]
    named = [("" if r.doc_id is None else r.doc_id, r.source, r.text) for r in before]
    want = {d for d, *_ in brute.mix([(d, s, t) for d, s, t in named if d != ""] + [(d, s, t) for d, s, t in named if d == ""], C.WEIGHTS, C.BUDGET_SHARE)}
    assert {"" if r.doc_id is None else r.doc_id for r in after} == want and len(after) < len(before)

    _, before, after = steps[4]
    assert {(r.doc_id, r.text) for r in before} == {(r.doc_id, r.decoded) for r in after}
    assert sorted(map(repr, after)) == sorted(map(repr, C.run(spark, folder).collect()))


def test_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and {x.split("_")[0] for x in names if x.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert set(E.oracle_sql()) <= names
