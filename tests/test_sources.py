"""Readers and writers on small files."""

import numpy as np
import pytest

from seqloom.operators.motifs import Motif
from seqloom.sources import motif_files, sinks, text


def written(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_fasta(spark, tmp_path):
    path = written(tmp_path, "a.fa", ">one x>y\nACGT\nacnn\n>two\nA-C\n>three\nGG\n")
    rows = [tuple(r) for r in text.fasta(spark, path).orderBy("seq_id").collect()]
    assert rows == [(0, "one x>y", "ACGTAC"), (1, "two", "ANC"), (2, "three", "GG")]
    assert text.fasta(spark, path, drop_last=True).count() == 2 and text.fasta(spark, path, limit=0).count() == 1
    out = str(tmp_path / "out")
    sinks.write_fasta(text.fasta(spark, path), out)
    assert text.fasta(spark, out).count() == 3


def test_numbers(spark, tmp_path):
    rows = text.intensities(spark, written(tmp_path, "p.txt", "20000\tACGNT\n60000 GGG\n")).orderBy("seq_id").collect()
    assert [(r.seq, round(r.weight, 6)) for r in rows] == [("ACGT", 0.5), ("GGG", 1.5)]
    seqs = spark.createDataFrame([(i,) for i in range(3)], "seq_id long")
    assert [r.weight for r in text.weights(spark, written(tmp_path, "w.txt", "a:1.5 b:2\n"), seqs).orderBy("seq_id").collect()] == [1.5, 2.0, 2.0]
    signal = text.matrix(spark, written(tmp_path, "m.txt", "1\t2\t3\n4\t5\t6\n"))
    assert {(r.seq_id, r.bin): r.total for r in text.signal_bins(signal, 2).collect()} == {(0, 0): 3.0, (0, 1): 3.0, (1, 0): 9.0, (1, 1): 6.0}


def test_peaks_and_answers(spark, tmp_path):
    peaks = text.peaks(spark, written(tmp_path, "peaks.txt", "chr1 100 200\nchr2 1000 1100\n"))
    rows = {(r.peak, r.side): list(r.coords) for r in text.flanking(peaks, 50).collect()}
    assert rows == {(0, "right"): [250, 350], (1, "right"): [1150, 1250], (1, "left"): [850, 950]}
    found = text.answers(spark, written(tmp_path, "x.ans", "m\tACG\t3\t17\nbad\n")).collect()
    assert [tuple(r) for r in found] == [(3, 17)]
    sites = text.predicted_sites(spark, written(tmp_path, "s.txt", "head\ns1,5\ns2,6\n\nnext\ns3,7\n"), "csv").orderBy("pos").collect()
    assert [tuple(r) for r in sites] == [(0, "s1", 5), (0, "s2", 6), (1, "s3", 7)]


ROWS = "0.9 0.03 0.03 0.04\n0.1 0.7 0.1 0.1\n0.1 0.1 0.7 0.1\n0.1 0.1 0.1 0.7\n0.7 0.1 0.1 0.1\n"
NUMBERED = "".join(f"{i} {r}\n" for i, r in enumerate(ROWS.strip().split("\n"), 1))
BY_BASE = ["0.9 0.1 0.1 0.1 0.7", "0.03 0.7 0.1 0.1 0.1", "0.03 0.1 0.7 0.1 0.1", "0.04 0.1 0.1 0.7 0.1"]
FILES = {
    "x.pwm": f"DE\tm1\tACGTA\t12.5\nPO\tA\tC\tG\tT\n{NUMBERED}XX\nDE\tm2\tACGTA\t3\nPO\tA\tC\tG\tT\n{NUMBERED}XX\n",
    "x.dat": f"NA m1\nP0 A C G T\n{NUMBERED}XX\nNA m2\nP0 A C G T\n{NUMBERED}XX\n",
    "x.jaspar": "".join(f">m{i}\n" + "\n".join(f"{b} [ {r} ]" for b, r in zip("ACGT", BY_BASE)) + "\n" for i in (1, 2)),
    "x.meme": "".join(f"MOTIF m{i}\nletter-probability matrix: alength= 4 w= 5 nsites= 20 E= 0\n{ROWS}\n" for i in (1, 2)),
    "chipmunk.txt": "".join("KDIC|1.5\n" + "\n".join(f"{b}|{r}" for b, r in zip("ACGT", BY_BASE)) + "\n" for _ in (1, 2)),
    "thetafinal.txt": "\n".join(BY_BASE * 2),
    "zifnet.txt": "\n".join(f"m{i} {r}" for i in (1, 2) for r in BY_BASE),
    "uniprobe.txt": "".join(f"m{i}\n" + "\n".join(f"{b}:\t{r}" for b, r in zip("ACGT", BY_BASE)) + "\n" for i in (1, 2)),
    "cisfinder.txt": "".join(f">m{i}\n{NUMBERED}" for i in (1, 2)),
    "weeder.txt": "".join(f"All Occurrences\n{NUMBERED}\n" for _ in (1, 2)),
    "trawler.txt": "".join(f">m{i}\n{ROWS}" for i in (1, 2)),
    "amadeus.txt": "".join(f"Motif m{i}\n{NUMBERED}" for i in (1, 2)),
    "x.transfac": f"DE,m1,x\nPO,A,C,G,T\n{NUMBERED.replace(' ', ',')}XX\nDE,m2,x\n{NUMBERED.replace(' ', ',')}XX\n",
}


@pytest.mark.parametrize("name", sorted(FILES))
def test_motif_formats(spark, tmp_path, name):
    found = motif_files.read(spark, written(tmp_path, name, FILES[name]))
    assert len(found) == 2
    for m in found:
        assert m.best() == "ACGTA" and np.allclose(m.weights.sum(axis=1), 1)


def test_details(spark, tmp_path):
    found = motif_files.read(spark, written(tmp_path, "x.pwm", FILES["x.pwm"]), limit=1)
    assert [m.name for m in found] == ["m1"] and found[0].score == 12.5
    assert [m.name for m in motif_files.uniprobe(FILES["uniprobe.txt"], compat=True)] == ["m2", "m2"]
    assert motif_files.read(spark, written(tmp_path, "y.meme", FILES["x.meme"]))[0].sites == 20
    gap = motif_files.read(spark, written(tmp_path, "x.dpwm", f"DE\tm1\tACGTA\t1\nPO\tA\tC\tG\tT\n{NUMBERED}XXD\n0-2:AG|0.5\tN|0.5\nXXX\n"))
    assert gap[0].extra["groups"] == {(0, 2): {"AG": 0.5, "N": 0.5}}
    with pytest.raises(ValueError):
        motif_files.read(spark, str(tmp_path / "x.unknown"))
    other = written(tmp_path, "z.unknown", FILES["x.jaspar"])
    assert [m.name for m in motif_files.read(spark, other, layout="jaspar")] == ["m1", "m2"] == [m.name for m in motif_files.read(spark, written(tmp_path, "z.other", FILES["x.pwm"]), layout=".pwm")]


def test_round_trips(spark, tmp_path):
    from pyspark.sql import functions as F

    from seqloom.operators import background

    motifs = [Motif.of_consensus("a", "ACGTT", score=2.0), Motif.of_consensus("b", "GGATC", score=2.0)]
    path = str(tmp_path / "out.pwm")
    sinks.write_motifs(spark, motifs, path, by_score=True)
    back = motif_files.read(spark, path)
    assert [m.name for m in back] == ["a", "b"] and np.allclose(back[0].weights, motifs[0].weights, atol=1e-5)
    seqs = spark.createDataFrame([(0, "ACGTACGTTT")], "seq_id long, seq string")
    model = background.fit(seqs, 1)
    sinks.write_background(model, str(tmp_path / "bg"), 1)
    again = {r.prefix: r.p for r in motif_files.read_background(spark, str(tmp_path / "bg")).collect()}
    assert all(abs(again[r.prefix] - r.p) < 1e-9 for r in model.collect())
    hits = spark.createDataFrame([(0, 2, -1.5, True)], "seq_id long, pos int, score double, reverse boolean")
    sinks.write_positions(hits, seqs, 4, str(tmp_path / "pos"))
    row = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "pos")).first()
    assert row.site == "GTAC" and row.strand == "-"
    assert spark.range(1).select(text.clean(F.lit("aXc"))).first()[0] == "AC"


def test_amino_acids(spark, tmp_path):
    rows = text.amino_acids(spark, written(tmp_path, "aa.txt", "1 ACD 0.1,0.2,0.3,0.4 p1\n2 CCC 0.7,0.1,0.1,0.1\nbad line\n3 AAA 1,2\n"))
    got = text.residues(rows, 2).orderBy("row").collect()
    assert [(r.col, r.aa, list(r.probs), r.protein, sum(r.features)) for r in got] == [(1, "ACD", [0.1, 0.2, 0.3, 0.4], "p1", 2.0), (2, "CCC", [0.7, 0.1, 0.1, 0.1], None, 2.0)]


#: Two lines of each tool's report, one of them on the reverse strand where the tool tells.
REPORTS = {
    "out": ([">SEQ_3 f17 ACGT", ">SEQ_4 b20 ACGT"], [("3", 17, False), ("4", 180, True)]),
    "mds_out": ([">name_1 len 200 f17 ACGT", ">SEQ_4 len 200 b20 ACGT"], [("name_1", 17, False), ("4", 180, True)]),
    "bpout": ([">SEQ_3 len 200 f17 0.5 ACGT", ">SEQ_4 len 200 r20 0.5 ACGT"], [("3", 17, False), ("4", 180, True)]),
    "annspec_out": (["site 1 2.5 17 ACGT 0.5 >SEQ_3", "site 2 2.5 20 ACGT 0.5 >SEQ_4"], [("3", 17, False), ("4", 20, False)]),
    "wee": (["  3 + ACGT 17 (98.5)", "  4 - [ACGT] 20 (90.1)"], [("3", 17, False), ("4", 180, True)]),
    "txt": (["MACS_LNCAPARDHT_001776      179  5.25e-06 TCAACTTATT CTCCTGCC TCAGTTTTCC", "SEQ_4 20 1.00e-05 AC"], [("MACS_LNCAPARDHT_001776", 179, False), ("4", 20, False)]),
    "meme_out": (["SEQ_3   +  17  1.25e-06 ACGT", "name_4  -  20  2.50e-06 ACGT"], [("3", 17, False), ("name_4", 180, True)]),
}


@pytest.mark.parametrize("suffix", sorted(REPORTS))
def test_reports_of_tools(spark, tmp_path, suffix):
    (first, second), wanted = REPORTS[suffix]
    path = written(tmp_path, f"report.fa.{suffix}", f"# head\n{first}\n\n# next\n{second}\n")
    assert [tuple(r) for r in text.predicted_sites(spark, path).orderBy("list_id").collect()] == [(i, *w) for i, w in enumerate(wanted)]
    with pytest.raises(ValueError):
        text.predicted_sites(spark, str(tmp_path / "x.unknown"))


BARS = "\n".join(f"{b}|{'|'.join(r.split())}|" for b, r in zip("ACGT", BY_BASE))
AMADEUS = "".join(f"PwmMotif(m{i}): score 1.5\n |1|2|3|4|5|\n-----------\n{BARS}\n\n" for i in (1, 2))
SUFFIXES = {"x.admout": AMADEUS, "y.amadeus": AMADEUS, "x.traw": FILES["trawler.txt"], "x.cisf": FILES["cisfinder.txt"], "x.unip": FILES["uniprobe.txt"]}
SUFFIXES |= {"x.trans": FILES["x.transfac"], "meme.txt": FILES["x.meme"], "x.wee": FILES["weeder.txt"], "cisfinder.unip": FILES["cisfinder.txt"]}


@pytest.mark.parametrize("name", sorted(SUFFIXES))
def test_suffixes_of_older_programs(spark, tmp_path, name):
    found = motif_files.read(spark, written(tmp_path, name, SUFFIXES[name]))
    assert [m.best() for m in found] == ["ACGTA"] * 2
    if "PwmMotif" in SUFFIXES[name]:
        assert [m.name for m in found] == ["PwmMotif(m1)", "PwmMotif(m2)"] and np.allclose(found[0].weights[0], [0.9, 0.03, 0.03, 0.04], atol=1e-6)
