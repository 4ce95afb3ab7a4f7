"""Queries that SQL can't express, against brute force over whole small tables."""

import hashlib
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
import sentencepiece
from brute import brute_spans, united

import corpus_pipeline
from seqloom.llm import langid, pii, piece, quality, queries, rollup, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pii(spark, texts):
    got = run(spark, "op1_pii")
    assert len(got) == len(texts)
    for r in got:
        base = brute_spans(texts[r.doc_id])
        kinds = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        assert r.base_sha256 == sha(pii.listed(base)) and set(filter(None, pii.listed(base).split(","))) <= set(r.spans.split(","))


def test_token_counts(spark, texts):
    encode = rollup._encoding(rollup.default_ranks()).encode_ordinary
    docs, tokens = Counter(), Counter()
    for i, source, lang in duckdb.sql(f"SELECT doc_id, source, lang FROM '{SF}/documents.parquet'").fetchall():
        docs[source, lang] += 1
        tokens[source, lang] += len(encode(texts[i]))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in run(spark, "op2_token_counts")}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_lattice(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    u = np.array([r[1] for r in rows], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    ids = [r[0] for r in rows]
    at = {v: i for i, v in enumerate(ids)}
    root = united(ids, lambda x, y: near[at[x], at[y]])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, "op3_lattice")}
    assert got == {v: (int(near[i].sum()), root[v], root[v] == v) for i, v in enumerate(ids)}


def test_pieces(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece.default_model())
    for r in run(spark, "op7_sentencepiece"):
        ids = sp.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_simhash(spark, texts):
    prints = {i: simhash.fingerprint(t.encode()) & ((1 << 64) - 1) for i, t in texts.items()}
    root = united(sorted(texts), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op10_simhash")}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in texts}


@pytest.mark.parametrize("name", ["op4_quality", "op5_toxicity", "op9_language"])
def test_scores(spark, texts, name):
    """Scores by the learned model, one n-gram or one window at a time."""
    modulus, held = {"op4_quality": (3, 1), "op5_toxicity": (4, 2), "op9_language": (5, 0)}[name]
    got = {r.doc_id: r for r in run(spark, name)}
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == held) for i, r in got.items())
    if name == "op9_language":
        model = langid.train(docs.where("crc32(cast(doc_id as string)) % 5 <> 0")).model(0)
        for i, t in texts.items():
            wanted = brute.language(model, t)
            assert got[i].lang_pred == wanted[0] and abs(got[i].score - wanted[1]) < 1e-6
        return
    model = quality.train(docs, labels) if name == "op4_quality" else toxicity.train(docs, labels)
    for i, t in texts.items():
        assert got[i].predicted == int(got[i].score >= (0.5 if name == "op4_quality" else 0.3))
        if name == "op4_quality":
            assert abs(got[i].score - brute.quality(model, t)) < 1e-6
        else:
            assert abs(got[i].score - brute.toxicity(model, t)) < 1e-3


def test_decontamination(spark, texts):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    wanted = {(i, k): len(d) for i, t in texts.items() for k, item in items if (d := brute.passages(t, item))}
    assert {(r.doc_id, r.item_id): r.n_places for r in run(spark, "op8_decontaminate")} == wanted and wanted


def test_pipeline(spark, texts, monkeypatch):
    """Each stage by brute force, after another. The threshold lies in a gap of the scores, so that some texts are rejected."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net, sp = toxicity.train(docs, labels), sentencepiece.SentencePieceProcessor(model_file=piece.default_model())
    scores = {i: brute.toxicity(net, t) for i, t in texts.items()}
    ranked = sorted(scores.values())
    gap = max(range(len(ranked) - 30, len(ranked) - 4), key=lambda k: ranked[k + 1] - ranked[k])
    limit = (ranked[gap] + ranked[gap + 1]) / 2
    monkeypatch.setattr(corpus_pipeline, "TOXIC", limit)
    left = {i: t for i, t in texts.items() if scores[i] < limit}
    assert 0 < len(left) < len(texts)
    prints = {i: simhash.fingerprint(t.encode()) & ((1 << 64) - 1) for i, t in left.items()}
    root = brute.united(sorted(left), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2)
    singles = {i: t for i, t in left.items() if root[i] == i}
    items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    clean = {i: t for i, t in singles.items() if not any(brute.passages(t, item) for (item,) in items)}
    assert len(clean) < len(singles) < len(left)
    wanted = {}
    for i, t in clean.items():
        base = brute.brute_spans(t)
        wanted[i] = sp.encode(pii.redacted(t, pii.in_order(base + pii.model().added(t, base))), add_eos=True)
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()} == wanted
