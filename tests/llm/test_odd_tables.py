"""All queries and stages over odd tables and empty ones."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from seqloom.llm import queries

PER_ROW = ["op1_pii", "op4_quality", "op5_toxicity", "op6_licenses", "op7_sentencepiece", "op9_language", "op10_simhash"]


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(spark, odd_tables, name):
    full, empty, rows, _ = odd_tables
    got = queries.QUERIES[name](spark, full).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    repeated = [r for r in got if r.doc_id == 5]
    assert len(repeated) == 3 and len({tuple(r) for r in repeated}) == 1
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_defined_results(spark, odd_tables):
    full, _, rows, _ = odd_tables
    blank = {r[0] for r in rows if r[0] is not None and not (r[1] or "").strip()}
    run = lambda name: {r.doc_id: r for r in queries.QUERIES[name](spark, full).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    pii, codes, lang, prints, licenses = run("op1_pii"), run("op7_sentencepiece"), run("op9_language"), run("op10_simhash"), run("op6_licenses")
    for i in blank:
        assert pii[i].base_sha256 == empty and pii[i].spans == "" and lang[i].lang_pred == "und" and lang[i].score == 0
        assert prints[i].fingerprint == "0" * 16 and prints[i].component_id == min(blank)
        assert licenses[i].n_words == 0 and licenses[i].first_word is None and licenses[i].labels == "" and licenses[i].score == 0
    for i, t in ((r[0], r[1]) for r in rows if r[0] is not None):
        if not t:
            assert codes[i].n_tokens == 1 and codes[i].decoded_sha256 == empty
        else:
            assert codes[i].decoded_sha256 == hashlib.sha256(t.replace("▁", " ").encode()).hexdigest()


def test_embeddings(spark, odd_tables):
    full, empty, _, vectors = odd_tables
    got = queries.QUERIES["op3_lattice"](spark, full).collect()
    assert len(got) == len(vectors) + 2 and queries.QUERIES["op3_lattice"](spark, empty).count() == 0
    by = {r.vec_id: r for r in got if r.vec_id not in (None, 4)}
    assert [by[i].n_links for i in (0, 30, 31)] == [2, 2, 2] and by[30].component_id == 0 and not by[30].kept
    assert by[1].n_links == 1 == by[32].n_links and by[32].component_id == 1
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(33, 40))
    assert [r.n_links for r in got if r.vec_id == 4] == [1, 1] and next(r for r in got if r.vec_id is None).n_links == 0


def test_token_counts(spark, odd_tables):
    full, empty, rows, _ = odd_tables
    got = queries.QUERIES["op2_token_counts"](spark, full).collect()
    assert sum(r.n_docs for r in got) == len(rows) and queries.QUERIES["op2_token_counts"](spark, empty).count() == 0


def test_decontamination(spark, odd_tables):
    full, empty, _, _ = odd_tables
    got = queries.QUERIES["op8_decontaminate"](spark, full).collect()
    assert [(r.doc_id, r.item_id, r.n_equal) for r in got] == [(43, 0, 20)]
    assert queries.QUERIES["op8_decontaminate"](spark, empty).count() == 0


def test_pipeline(spark, odd_tables):
    full, empty, rows, _ = odd_tables
    docs = spark.read.parquet(f"{full}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        after = stage(spark, docs, full)
        if name != "sentencepiece":
            assert after.columns == docs.columns
        kept = after.count()
        assert kept <= before and (name in ("toxicity", "simhash", "decontamination") or kept == before)
        if name == "simhash":
            ids = Counter(r.doc_id for r in after.select("doc_id").collect())
            assert all(n == 1 for i, n in ids.items() if i is not None)
        if name == "decontamination":
            assert after.where("doc_id = 43").count() == 0
        if name == "pii":
            assert after.where("text LIKE '%a@b.c%'").count() == 0 or before == 0
        docs = after
    assert corpus_pipeline.run(spark, empty).count() == 0
