"""Command line: python -m seqloom.cli COMMAND ... Every command reads and writes paths that Spark reads and writes."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import learn, sampling, scan, thresholds
from .plans import workflows
from .sources import motif_files, sinks, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description="Motif analytics on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        c.add_argument("-i", "--input", required=True, help="FASTA of the sequences")
        c.add_argument("-o", "--output", required=True, help="folder or prefix of the results")
        c.add_argument("-c", "--control", help="FASTA of negative sequences; else random ones are drawn from the background")
        c.add_argument("--pwm", help="motif file")
        c.add_argument("--fdr", type=float, default=0.001, help="chance that a random window is a site")
        c.add_argument("--bg-order", type=int, default=2, help="order of the background chain")
        return c

    c = command("discover", "find motifs")
    c.add_argument("--seedlen", type=int, default=5)
    c.add_argument("-n", "--motifs", type=int, default=5)
    c.add_argument("--minlen", type=int, default=7)
    c.add_argument("--maxlen", type=int, default=25)
    c.add_argument("--mincount", type=int, default=10)
    c.add_argument("--rounds", type=int, default=50)
    c.add_argument("--overlap", type=float, default=0.1)
    c = command("evaluate", "AUC, mean log-likelihood ratio and hit rates of motifs")
    c.add_argument("--library", help="motif file to compare with")
    c.add_argument("--divergence", type=float, default=0.24)
    command("scan", "positions of all sites")
    c = command("cluster", "representatives of similar motifs")
    c.add_argument("--linkage", default="WPGMA", choices=["SINGLE", "COMPLETE", "UPGMA", "WPGMA", "UPGMC", "WPGMC", "WARD"])
    c.add_argument("--cut", type=float, default=0.2)
    c = command("simulate", "plant sites of a motif and write the truth")
    c.add_argument("--share", type=float, default=0.5)
    c.add_argument("--seed", type=int, default=1)
    command("mask", "overwrite sites by N")
    c = command("combine", "AUC of every set of motifs by their profiles' window maxima")
    c.add_argument("--reach", type=int, default=20)
    c.add_argument("--one-strand", action="store_true")
    c = command("peaks", "regions beside peaks; the input has lines of a chromosome and its numbers")
    c.add_argument("--width", type=int, default=100)
    c = command("predict", "columns of residues; the input has lines of column, residues and, to learn from, four probabilities")
    c.add_argument("--train", required=True)
    c.add_argument("--residues", type=int, default=4)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "peaks":
        sinks.write_table(text.flanking(text.peaks(spark, args.input), args.width), f"{args.output}/regions")
        return
    if args.command == "predict":
        known, asked = (text.residues(text.amino_acids(spark, path), args.residues) for path in (args.train, args.input))
        sinks.write_table(learn.predicted_columns(known, asked).drop("features"), f"{args.output}/columns")
        return
    seqs = text.fasta(spark, args.input)
    motifs = motif_files.read(spark, args.pwm) if args.pwm else []
    if args.command != "discover" and not motifs:
        raise SystemExit("--pwm with at least one motif is needed")
    negatives = text.fasta(spark, args.control).withColumn("seq_id", -1 - F.col("seq_id")) if args.control else None
    if args.command == "discover":
        settings = workflows.Discovery(args.seedlen, args.motifs, args.bg_order, args.rounds, 0.05, args.maxlen, args.minlen, args.mincount, args.overlap)
        sinks.write_motifs(spark, workflows.discover(seqs, negatives, settings), f"{args.output}/motifs.pwm", by_score=True)
    elif args.command == "evaluate":
        negatives = workflows.controls(seqs, args.bg_order) if negatives is None else negatives
        sinks.write_table(workflows.evaluate(motifs, seqs, negatives, args.fdr).orderBy(F.desc("auc"), "motif"), f"{args.output}/evaluation")
        if args.library:
            near = workflows.nearest(motifs, motif_files.read(spark, args.library), within=args.divergence)
            sinks.write_table(spark.createDataFrame(near, "motif string, other string, divergence double"), f"{args.output}/nearest")
    elif args.command == "combine":
        negatives = workflows.controls(seqs, args.bg_order) if negatives is None else negatives
        sinks.write_table(workflows.combinations(motifs, seqs, negatives, args.reach, args.one_strand).orderBy(F.desc("auc"), "motifs"), f"{args.output}/combinations")
    elif args.command == "scan":
        q = workflows.base_frequencies(seqs)
        for m in motifs:
            sinks.write_positions(scan.scan(seqs, [m], thresholds.threshold(m, args.fdr, q)), seqs, len(m), f"{args.output}/{m.name}.pos")
    elif args.command == "cluster":
        sinks.write_motifs(spark, workflows.clustered(motifs, args.linkage, args.cut), f"{args.output}/clustered.pwm", by_score=True)
    elif args.command == "simulate":
        planted = sampling.planted(seqs, motifs[0], args.share, args.seed)
        sinks.write_fasta(planted, f"{args.output}/sequences.fa")
        sinks.write_answers(planted, motifs[0].name, f"{args.output}/sequences.ans")
    elif args.command == "mask":
        sinks.write_fasta(workflows.masked(seqs, motifs, args.fdr), f"{args.output}/masked.fa")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
