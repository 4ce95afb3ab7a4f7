"""Whole runs through the command line, and counts over a stream."""

import numpy as np

from seqloom import cli, streaming
from seqloom.operators.motifs import Motif, divergence
from seqloom.plans import workflows
from seqloom.sources import motif_files, sinks, text


def test_simulate_discover_evaluate(spark, tmp_path):
    rng = np.random.default_rng(4)
    fasta = tmp_path / "in.fa"
    fasta.write_text("".join(f">s{i}\n{''.join(rng.choice(list('ACGT'), 60))}\n" for i in range(300)))
    truth = Motif.of_consensus("truth", "GATTACAG", 0.97)
    (tmp_path / "truth.pwm").write_text(sinks.motif_text([truth]))
    run = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    run("simulate", "-i", fasta, "-o", tmp_path / "sim", "--pwm", tmp_path / "truth.pwm", "--share", 0.8)
    assert 200 < text.answers(spark, str(tmp_path / "sim/sequences.ans")).count() < 280
    planted = str(tmp_path / "sim/sequences.fa")
    run("discover", "-i", planted, "-o", tmp_path / "found", "-n", 2, "--rounds", 8, "--maxlen", 10, "--mincount", 5)
    found = motif_files.read(spark, str(tmp_path / "found/motifs.pwm"))
    assert found and min(divergence(m, truth, 5) for m in found) < 0.2
    run("evaluate", "-i", planted, "-o", tmp_path / "eval", "--pwm", tmp_path / "truth.pwm", "--library", tmp_path / "truth.pwm")
    row = spark.read.parquet(str(tmp_path / "eval/evaluation")).first()
    assert row.auc > 0.85 and row.z > 5 and spark.read.parquet(str(tmp_path / "eval/nearest")).first().divergence < 1e-9
    run("scan", "-i", planted, "-o", tmp_path / "scan", "--pwm", tmp_path / "truth.pwm")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "scan/truth.pos")).count() > 150
    run("mask", "-i", planted, "-o", tmp_path / "mask", "--pwm", tmp_path / "truth.pwm")
    masked = spark.read.text(str(tmp_path / "mask/masked.fa"))
    assert masked.where("value LIKE '%NNNNNNNN%'").count() > 150 and masked.where("value LIKE '%GATTACAG%'").count() == 0
    (tmp_path / "two.pwm").write_text(sinks.motif_text([truth, Motif.of_consensus("other", "CCCGGGTT", 0.97)]))
    run("combine", "-i", planted, "-o", tmp_path / "comb", "--pwm", tmp_path / "two.pwm", "--reach", 5)
    sets = {r.motifs: r.auc for r in spark.read.parquet(str(tmp_path / "comb/combinations")).collect()}
    assert set(sets) == {"truth", "other", "truth+other"} and sets["truth"] > 0.85 > 0.6 > sets["other"]
    run("cluster", "-i", planted, "-o", tmp_path / "clust", "--pwm", tmp_path / "found/motifs.pwm")
    assert 1 <= len(motif_files.read(spark, str(tmp_path / "clust/clustered.pwm"))) <= len(found)


def test_peaks_and_columns(spark, tmp_path):
    run = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    (tmp_path / "peaks.txt").write_text("chr1 100 200\nchr2 1000 1100\n")
    run("peaks", "-i", tmp_path / "peaks.txt", "-o", tmp_path / "out", "--width", 50)
    assert spark.read.parquet(str(tmp_path / "out/regions")).count() == 3
    rows = [("AAAA", "0.9,0.03,0.03,0.04"), ("CCCC", "0.02,0.9,0.04,0.04"), ("DDDD", "0.02,0.04,0.04,0.9")]
    (tmp_path / "train.txt").write_text("".join(f"{i} {rows[i % 3][0]} {rows[i % 3][1]}\n" for i in range(30)))
    (tmp_path / "asked.txt").write_text("1 AAAA 1,0,0,0\n2 CCCC 1,0,0,0\n3 DDDD 1,0,0,0\n")
    run("predict", "-i", tmp_path / "asked.txt", "--train", tmp_path / "train.txt", "-o", tmp_path / "out")
    got = {r.aa: list(r.predicted) for r in spark.read.parquet(str(tmp_path / "out/columns")).collect()}
    assert all(np.allclose(got[aa], [float(x) for x in p.split(",")], atol=1e-6) for aa, p in rows)


def test_clean_controls(spark):
    rows = spark.createDataFrame([(i, "ACGTTGCA" if i % 3 == 0 else "TTTTTTTT") for i in range(3000)], "seq_id long, seq string")
    other = spark.createDataFrame([(0, "GACGTTG")], "seq_id long, seq string")
    got = sorted(r.seq_id for r in workflows.clean_controls(rows, other, 6).collect())
    assert got == [i for i in range(3000) if i % 3][:1001] and workflows.clean_controls(rows, other, 6, capped=False).count() == 2000


def test_no_seeds(spark):
    seqs = spark.createDataFrame([(0, "ACGT"), (1, "")], "seq_id long, seq string")
    assert workflows.discover(seqs, settings=workflows.Discovery(seed_length=5)) == []


def test_stream(spark, tmp_path):
    spark.createDataFrame([("ACGTA",), ("ACG",)], "seq string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("seq string").parquet(str(tmp_path / "s"))
    q = streaming.counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("kmer_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r.kmer: r.n for r in spark.table("kmer_counts").collect()} == {"ACG": 2, "CGT": 1, "GTA": 1}
