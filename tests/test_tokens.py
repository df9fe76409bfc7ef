import random

import pytest
from pyspark.sql import functions as F

from sparklode.functions import tokens as K
from sparklode.operators.shred import shred, shred_plan


def distinct(text):
    return {t[0] for t in K.shred(text)}


def test_address_becomes_a_hierarchy():
    got = list(K.shred("user@example.com"))
    assert got == [("user@example.com", 3, None), ("user", 28, "user@example.com"), ("example.com", 4, "user@example.com"), ("example", 24, "example.com"), ("com", 24, "example.com")]


def test_word_alone_and_in_a_sentence():
    assert list(K.shred("alice")) == [("alice", 31, None)]
    assert list(K.shred("alice bob")) == [("alice", 30, None), ("bob", 30, None)]


@pytest.mark.parametrize("text,n", [("", 0), (" ,;", 0), ("@@", 1), ("...", 1), ("--", 1), ("a  b  c  d  e  f", 6), ("  a b c d", 4), ("a b c d  ", 4)])
def test_number_of_tokens(text, n):
    assert len(distinct(text)) == n


def test_three_levels_of_parents():
    by = {t: p for t, _, p in K.shred("a/b.c-d")}
    assert by == {"a/b.c-d": None, "a": "a/b.c-d", "b.c-d": "a/b.c-d", "b": "b.c-d", "c-d": "b.c-d", "c": "c-d", "d": "c-d"}


def test_case_unicode_and_brackets_are_kept():
    assert distinct("Ünï[x]% 日本") == {"Ünï[x]%", "日本"}


def test_long_cell():
    assert list(K.shred("x" * 50_000)) == [("x" * 50_000, 31, None)]


def test_phrases():
    assert K.split_phrase("/usr") == [] and K.split_phrase(" alice") == [] and K.split_phrase("") == []
    assert K.split_phrase("alice") == ["alice"]
    assert K.split_phrase("user@example.com") == ["com", "example", "example.com", "user", "user@example.com"]
    assert [K.phrase_level(x) for x in ("a b", "a/b", "a.b", "a-b", "ab")] == [0, 1, 2, 3, 4]


def test_shredders_agree_on_random_text(spark):
    rng = random.Random(5)
    alphabet = "ab" + "".join(K.LEVELS) + "é日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    cells = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((i, k, s, p or "") for i, t in enumerate(texts) for k, s, p in K.shred(t))
    for how in (shred, shred_plan):
        got = how(cells).select("id", "keyword", "splits", F.coalesce("parent", F.lit(""))).collect()
        assert sorted(map(tuple, got)) == want
    ordered = shred_plan(cells).orderBy("id", "ord").select("id", "keyword").collect()
    assert [tuple(r) for r in ordered] == [(i, k) for i, t in enumerate(texts) for k, _, _ in K.shred(t)]
