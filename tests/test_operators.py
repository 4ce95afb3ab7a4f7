"""Hand-made cases of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna, ordered, special, stats
from seqloom.operators import background, cluster, em, kmers, metrics, positions, sampling, scan, thresholds
from seqloom.operators.motifs import Motif, divergence, from_sites, normalise


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def seqs(spark, *rows):
    return spark.createDataFrame([(i, s, 1.0) for i, s in enumerate(rows)], "seq_id long, seq string, weight double")


def test_reverse_complement(spark):
    assert one(spark, dna.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, dna.reverse_complement(dna.reverse_complement(F.lit("ACGTNRYKMSWBDHV")))) == "ACGTNRYKMSWBDHV"
    assert one(spark, dna.reverse_complement(F.lit("WS"), "correct")) == "SW"
    assert one(spark, dna.reverse_complement(F.lit("WS"), "compat")) == "WS"


def test_kmers(spark):
    rows = kmers.explode(seqs(spark, "ACGTA", "AC", ""), 3)
    assert [tuple(r) for r in rows.orderBy("pos").collect()] == [(0, 0, "ACG"), (0, 1, "CGT"), (0, 2, "GTA")]
    assert kmers.explode(seqs(spark, "ACGTA"), 3, compat=True).count() == 2
    assert one(spark, dna.code(F.lit("CGT"))) == 27 and one(spark, dna.from_code(F.lit(27), 3)) == "CGT" and one(spark, dna.code(F.lit("CNT"))) == -1


def test_expansions_and_neighbours(spark):
    assert sorted(one(spark, dna.expansions(F.lit("ANC")))) == ["AAC", "ACC", "AGC", "ATC"]
    assert one(spark, dna.expansions(F.lit("AC"))) == ["AC"]
    assert len(one(spark, dna.neighbours(F.lit("AAA")))) == 20
    assert one(spark, dna.mismatches(F.lit("ANCT"), F.lit("AGCA"))) == 1 and one(spark, dna.hamming(F.lit("ACGT"), F.lit("CGTA"))) == 4


def test_sites(spark):
    assert one(spark, dna.site(F.lit("ACGT"), F.lit(-2), 5)) == "NNACG"
    assert one(spark, dna.site(F.lit("ACGT"), F.lit(2), 5)) == "GTNNN"
    assert one(spark, dna.site(F.lit("ACGT"), F.lit(5), 5)) == ""
    assert one(spark, dna.cleaned_site(F.lit("ANCTGA"))) == "NNNTGA" and one(spark, dna.cleaned_site(F.lit("ACCTNA"))) == "ACCNNN"
    assert one(spark, dna.masked(F.lit("AACGAACG"), F.array(F.lit("ACG")))) == "ANNNANNN"


def test_spaced_and_greedy(spark):
    rows = spark.createDataFrame([(1, p) for p in (1, 3, 9, 12, 30)], "g int, pos int")
    assert sorted(r.pos for r in positions.spaced(rows, ["g"], "pos", 5).collect()) == [1, 9, 30]
    assert positions.greedy_pairs([1, 10, 20], [2, 11, 50], 2) == [(1, 2), (10, 11)]
    assert positions.greedy_pairs([1, 10, 20], [2, 11, 50], 2, compat=True) == [(1, 2), (10, 11)]
    left, right = (spark.createDataFrame([(1, p) for p in x], "g int, pos int") for x in ((1, 10, 20), (2, 11, 50)))
    assert sorted((r.a, r.b) for r in positions.greedy(left, right, "g", "pos", 2).collect()) == [(1, 2), (10, 11)]
    assert sorted((r.a, r.b) for r in positions.near(left, right, "g", "pos", 9).collect()) == [(1, 2), (1, 2 + 0)][:1] + [(10, 2), (10, 11), (20, 11)]


def test_background(spark):
    p = {r.prefix: r.p for r in background.fit(seqs(spark, "ACGT" * 50), 1).collect()}
    assert len(p) == 20 and all(abs(p[b] - 0.25) < 1e-3 for b in "ACGT") and p["AC"] > 0.99
    for parent in ("", "A", "C"):
        assert abs(sum(p[parent + b] for b in "ACGT") - 1) < 1e-12


def test_scan(spark):
    m = Motif.of_consensus("m", "ACGG")
    rows = seqs(spark, "TTACGGTT", "TTCCGTTT", "AC", None)
    best = {r.seq_id: (r.pos, r.reverse) for r in scan.scan(rows, [m], None, best_only=True).collect()}
    assert best == {0: (2, False), 1: (2, True)}
    uniform = Motif("u", np.full((3, 4), 0.25))
    assert {round(r.score, 6) for r in scan.scan(rows, [uniform]).collect()} == {round(3 * math.log(0.25), 6)}
    codes, _ = scan.numbered(__import__("pyarrow").array(["TTACGGTT"]))
    slow = [sum(m.logs[c]["ACGT".index("TTACGGTT"[i + c])] for c in range(4)) for i in range(5)]
    assert scan.scores(codes, m.logs).tolist() == pytest.approx(slow, abs=1e-8)
    hits = scan.scan(rows, [m])
    assert {r.seq_id: r.pos for r in scan.best_hits(hits).collect()} == {0: 2, 1: 2}


def test_scan_of_parts(spark):
    """Sequences that are longer than a part give what they give in one piece."""
    rng = random.Random(4)
    rows = seqs(spark, *("".join(rng.choice("ACGTN") for _ in range(n)) for n in (5000, 3, 0, 700, 12, 4999)), None).withColumn("weight", F.col("seq_id") * 1.5)
    motifs = [Motif.of_consensus("a", "TAATTA"), Motif.of_consensus("b", "GATNATCRY")]
    for more in ({"threshold": -9.0}, {"best_only": True}, {"threshold": -9.0, "located": True}):
        whole, parts = (sorted(map(tuple, scan.scan(rows, motifs, chunk=n, **more).collect())) for n in (1 << 20, 64))
        assert whole == parts and len(whole) > 6
    lengths = {r.seq_id: len(r.seq or "") for r in rows.collect()}
    assert all((r.seq_len, r.weight) == (lengths[r.seq_id], r.seq_id * 1.5) for r in scan.scan(rows, motifs, -9.0, located=True).collect())


def test_sums_by_group(spark):
    rng = random.Random(5)
    rows = [(g, float(v), rng.randint(1, 9)) for g in "abc" for v in rng.sample(range(1000), 200)]
    frame = spark.createDataFrame(rows, "g string, v double, n int")
    got = {(r.g, r.v): r.before_n for r in ordered.running_sums(frame, "v", ["n"], buckets=9, by="g").collect()}
    assert got == {(g, v): sum(n for h, u, n in rows if h == g and u < v) for g, v, _ in rows}


def test_sharing(spark):
    rows = seqs(spark, "ACGTACGTTT", "GGGGGGG", "TTTT", None)
    others = seqs(spark, "CGTTT", "GGC")
    assert sorted(r.seq_id for r in kmers.sharing(rows, others, 4).collect()) == [0]
    assert kmers.sharing(rows, others.limit(0), 4).count() == 0


def test_auc(spark):
    frame = lambda rows: spark.createDataFrame(rows, "score double, label int")
    assert metrics.auc(frame([(3.0, 1), (2.0, 1), (1.0, 0), (0.0, 0)])).first().auc == 1.0
    assert metrics.auc(frame([(1.0, 1), (1.0, 0), (1.0, 1), (1.0, 0)])).first().auc == 0.5
    assert metrics.confusion(frame([(3.0, 1), (2.0, 0), (1.0, 0)]), 2.0).first()[:4] == (1, 1, 1, 0)


def test_ranks(spark):
    rows = spark.createDataFrame([(i, float(i * 7 % 100)) for i in range(100)], "id long, v double")
    got = {r.id: r["rank"] for r in ordered.numbered(rows, "v", buckets=7).collect()}
    assert all(got[i] == i * 7 % 100 for i in range(100))
    assert ordered.numbered(rows.limit(0), "id").count() == 0


def test_motifs():
    m = Motif.of_consensus("m", "ACNRT")
    assert m.consensus() == "ACNRT" and m.reverse_complement().consensus() == "AYNGT" and m.best() == "ACAAT"
    assert np.allclose(normalise([[-1, 0, 0, 0], [2, 0, 0, 2]]).sum(axis=1), 1)
    assert divergence(m, m) == 0 and abs(divergence(m, m.reverse_complement())) < 1e-12
    assert Motif.of_consensus("w", "NNACGTACNN").trimmed().consensus() == "ACGTAC"
    assert from_sites("s", ["ACG", "ACT", "NCT"]).best() == "ACT"


def test_thresholds():
    m = Motif.of_consensus("m", "ACG")
    scores, p = thresholds.score_distribution(m)
    assert abs(p.sum() - 1) < 1e-12 and abs(scores[-1] - 3 * math.log(0.85)) < 0.01
    assert abs(thresholds.false_rate(m, thresholds.threshold(m, 0.02)) - 1 / 64) < 1e-9
    found = thresholds.instances(m, 0.7)
    assert found[0][0] == "ACG" and [x for _, x in found] == sorted((x for _, x in found), reverse=True)


def test_stats():
    assert abs(stats.binomial_tail(3, 10, 0.3) - sum(stats.binomial_pmf(k, 10, 0.3) for k in range(3, 11))) < 1e-12
    assert abs(stats.incomplete_gamma(2.5, 3.0) + stats.chi_square_tail(6.0, 5) - 1) < 1e-12
    assert abs(stats.normal_cdf(stats.normal_inverse(0.975)) - 0.975) < 1e-12
    assert abs(stats.digamma(1.0) + 0.5772156649015329) < 1e-10
    assert abs(stats.hypergeometric_cdf(2, 20, 8, 5) - sum(math.comb(8, i) * math.comb(12, 5 - i) for i in range(3)) / math.comb(20, 5)) < 1e-12
    a, b, c = stats.fit_decay(np.arange(30), 5 * np.exp(-0.2 * np.arange(30)) + 1)
    assert abs(a - 5) < 1e-5 and abs(b - 0.2) < 1e-6 and abs(c - 1) < 1e-5


def test_log_gamma(spark):
    for x in (0.5, 1.0, 7.25, 1000.0):
        assert abs(one(spark, special.log_gamma(F.lit(x))) - math.lgamma(x)) < 1e-9 * max(1, abs(math.lgamma(x)))


def test_em_recovers_a_planted_motif(spark):
    rng = np.random.default_rng(0)
    rows = seqs(spark, *("".join(rng.choice(list("ACGT"), 80)) for _ in range(400)))
    truth = Motif.of_consensus("m", "GATTACAG", 0.97)
    planted = sampling.planted(rows, truth, 0.7, 3).withColumn("seq", F.upper("seq")).persist()
    found = em.fit(planted, [em.State(Motif.of_consensus("m", "GATWACRG", 0.6))], np.full(4, 0.25), rounds=25)[0]
    assert found.motif.best() in ("GATTACAG", "CTGTAATC") and abs(found.share - 0.7) < 0.1
    best = scan.scan(planted, [found.motif], None, best_only=True).join(planted.where("pos IS NOT NULL").select("seq_id", F.col("pos").alias("real")), "seq_id")
    assert best.where("pos = real").count() >= 0.9 * best.count()
    wide = em.extend(planted, [em.State(Motif.of_consensus("m", "ATTAC", 0.9))], np.full(4, 0.25), least=7, rounds=6)[0]
    assert "GATTACA" in wide.motif.best() or "TGTAATC" in wide.motif.best()


def test_clusters(spark):
    d = np.array([[0, 1, 9], [1, 0, 8], [9, 8, 0]], dtype=float)
    for linkage in ("SINGLE", "COMPLETE", "UPGMA", "WPGMA", "UPGMC", "WPGMC", "WARD"):
        assert cluster.hierarchical(d, linkage, 2.0) == [[0, 1], [2]]
    assert cluster.greedy_filter(["a", "b", "c"], {("a", "b"): 0.5}, 0.1) == ["a", "c"]
    assert cluster.greedy_filter(["a", "b", "c"], {("a", "b"): 0.5}, 0.1, 3) == ["a", "b", "c"]
    assert cluster.longest_common("xxACGTyy", "zACGTz") == 4 and cluster.longest_common("", "A") == 0


def test_mixing_share(spark):
    rows = spark.createDataFrame([(10.0,)] * 30 + [(0.05,)] * 70, "r double")
    x = em.mixing_share(rows, "r")
    assert abs(sum(n * (r - 1) / (1 - x + x * r) for n, r in ((30, 10.0), (70, 0.05)))) < 1e-6


def test_gap_motifs(spark):
    m = Motif.of_consensus("g", "ACGT").with_groups({(1, 2): {"CG": 0.5, "GC": 0.4, "N": 0.1}})
    rows = seqs(spark, "TTACGTTT", "TTAGCTTT", "TTACCTTT", "TTANGTTT")
    best = {r.seq_id: r.score for r in scan.scan(rows, [m], None, best_only=True).collect()}
    assert abs(best[0] - (2 * math.log(0.85) + math.log(0.5))) < 1e-6 and abs(best[1] - (2 * math.log(0.85) + math.log(0.4))) < 1e-6
    assert abs(best[2] - (2 * math.log(0.85) + math.log(0.1 / 14))) < 1e-6 and m.parameters() == 8
    back = m.reverse_complement()
    assert back.extra["groups"] == {(1, 2): {"CG": 0.5, "GC": 0.4, "N": 0.1}} and back.reverse_complement().extra == m.extra
