"""The near-duplicate stage: which rows stay."""

import random

from brute import prose, united

import corpus_pipeline
from seqloom.llm import simhash


def test_one_of_each_group(spark):
    """Against the fingerprints of all pairs."""
    rng = random.Random(11)
    texts = []
    for size in (3, 30, 200, 900):
        for _ in range(6):
            words = prose(rng, size).split()
            texts += [" ".join(words), " ".join(words).upper() + " \n"]
            for n in (1, 1, 3):
                at = rng.randrange(len(words))
                texts.append(" ".join([*words[:at], *(f"new{rng.randrange(10**6)}" for _ in range(n)), *words[at + n :]]))
    prints = [simhash.fingerprint(t.encode()) & ((1 << 64) - 1) for t in texts]
    root = united(range(len(texts)), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in root if root[i] == i} and 24 < len(kept) < len(texts) - 24


def test_one_id_on_two_texts(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (8, b), (5, c), (9, d), (9, d), (9, d.upper()), (None, d), (None, a.upper()), (None, a.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(found[:], key=str) == sorted([(3, a), (5, b), (5, c), (9, next(t for i, t in found if i == 9))], key=str)
    alone = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(alone).collect()) == sorted([a, b])
