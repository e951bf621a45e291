"""Near copies against all pairs of plain five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near, simhash


def _plain(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _rows():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        rows.append(" ".join(words))
        for edits in rng.sample(range(1, 9), 3):
            other = list(words)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append(" ".join(other))
    return rows


def _kept(texts):
    sets = [_plain(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or shared / (len(sets[a] | sets[b]) or 1) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(k) for k in range(len(texts))}


@pytest.mark.parametrize("paired", [64, 8, 2])
def test_near_copies_equal_all_pairs(spark, paired):
    texts = [*_rows(), "", None, "two words", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit(1))
    left = near.keep_one(docs, paired=paired)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(_kept(texts))


def test_a_large_group_is_linked_through_all_it_has(spark, monkeypatch):
    """One text in hundreds of edited copies, many of which are only near to a few of the others."""
    monkeypatch.setattr(near, "BLOCK", 40)
    monkeypatch.setattr(near, "SET_BLOCK", 16)
    monkeypatch.setattr(near, "CLOSEST", 1)
    rng = random.Random(12)
    first = [f"w{rng.randrange(500)}" for _ in range(140)]
    texts = []
    for _ in range(240):
        words = list(first)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 8))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
        texts.append(" ".join(words))
    # a second group that shares half of its words
    other = first[:90] + [f"y{rng.randrange(500)}" for _ in range(50)]
    for _ in range(40):
        words = list(other)
        words[rng.randrange(len(words))] = "z"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near.keep_one(docs, paired=3).collect()} == _kept(texts)


def test_stage_drops_edited_copies_that_fingerprints_keep(spark):
    texts = _rows()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == _kept(texts) and len(left) < simhash.keep_one(docs).count()


def test_ids_that_are_null_or_repeated(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "x y z x y z"), (7, "x y z x y z"), (None, "x y z x y z")], "doc_id long, text string")
    assert sorted(near.keep_one(docs).collect(), key=str) == sorted(spark.createDataFrame([(None, "a b c d e f"), (7, "x y z x y z")], docs.schema).collect(), key=str)
    assert near.keep_one(docs.limit(0)).count() == 0
