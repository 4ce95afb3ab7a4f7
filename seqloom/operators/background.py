"""Markov background models as tables of (prefix, p): p of the prefix's last base after the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from . import kmers


def prefix_counts(sequences: DataFrame, order: int, weight=None) -> DataFrame:
    """(prefix, n): weighted counts of all strings of 1 to order + 1 letters on both strands.

    Only the longest strings are exploded, once and on one strand. Shorter ones are their beginnings, and those in the last
    ``order`` letters of a sequence; the other strand's counts are those of the reverse complements.
    """
    k = order + 1
    rows = sequences.select(F.lit(0).alias("seq_id"), "seq", (F.lit(1.0) if weight is None else F.col(weight)).alias("w"))
    own = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring(F.col("kmer"), F.lit(1), i))
    parts = kmers.explode(rows, k, "w").groupBy("kmer").agg(F.sum("w").alias("n")).select(F.explode(own).alias("prefix"), "n")
    if order:
        tail = F.right(F.col("seq"), F.lit(order))
        found = F.flatten(F.array(*(dna.windows(tail, i) for i in range(1, k))))
        parts = parts.union(rows.select(F.explode(found).alias("prefix"), F.col("w").alias("n")))
    both = parts.groupBy("prefix").agg(F.sum("n").alias("n")).select(F.explode(F.array("prefix", dna.reverse_complement("prefix"))).alias("prefix"), "n")
    return both.groupBy("prefix").agg(F.sum("n").alias("n"))


def fit(sequences: DataFrame, order: int, weight=None) -> DataFrame:
    """(prefix, p) with contexts of up to ``order`` letters; a prefix of k letters starts from a count of 4**-k."""
    every = sequences.sparkSession.range(sum(4**k for k in range(1, order + 2)))
    lengths = F.expr(" ".join(["CASE", *(f"WHEN id < {sum(4**j for j in range(1, k + 1))} THEN {k}" for k in range(1, order + 2)), "END"]))
    first = F.expr(" ".join(["CASE", *(f"WHEN id < {sum(4**j for j in range(1, k + 1))} THEN id - {sum(4**j for j in range(1, k))}" for k in range(1, order + 2)), "END"]))
    names = every.select(F.translate(F.lpad(F.conv(first.cast("string"), 10, 4), lengths, F.lit("0")), "0123", dna.BASES).alias("prefix"))
    counts = names.join(prefix_counts(sequences, order, weight), "prefix", "left")
    counts = counts.select("prefix", (F.coalesce("n", F.lit(0.0)) + F.pow(F.lit(4.0), -F.length("prefix"))).alias("n"))
    parent = F.substring(F.col("prefix"), F.lit(1), F.length("prefix") - 1)
    total = F.sum("n").over(Window.partitionBy(parent))  # over the 4 ** (order + 1) strings and their beginnings
    return counts.select("prefix", (F.col("n") / total).alias("p"))


def log_probability(sequences: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(seq_id, logp) of whole sequences under a model, which is broadcast: 4 ** (order + 1) rows for each length."""
    logs = model.select("prefix", F.log("p").alias("logp"))
    rows = sequences.select("seq_id", F.col("seq").cast("binary").alias("b"))
    rows = rows.select("seq_id", "b", F.explode(F.when(F.length("b") > 0, F.sequence(F.lit(1), F.length("b")))).alias("i"))
    prefix = F.substring(F.col("b"), F.greatest(F.col("i") - order, F.lit(1)), F.least(F.col("i"), F.lit(order + 1))).cast("string")
    return rows.select("seq_id", prefix.alias("prefix")).join(F.broadcast(logs), "prefix").groupBy("seq_id").agg(F.sum("logp").alias("logp"))


def flanks(sequences: DataFrame, k: int, width: int) -> DataFrame:
    """(kmer, col, base, n): bases around each k-mer, merged with its reverse complement; col is the offset from its start."""
    padded = sequences.select(F.concat(F.lit("N" * width), "seq", F.lit("N" * width)).cast("binary").alias("b"))
    rows = padded.where(F.length("b") >= k + 2 * width).select("b", F.explode(F.sequence(F.lit(1), F.length("b") - k - 2 * width + 1)).alias("pos"))
    around = F.substring(F.col("b"), F.col("pos"), F.lit(k + 2 * width)).cast("string")
    rows = rows.select(F.substring(around, width + 1, k).alias("kmer"), around.alias("around"))
    back = rows.select(dna.reverse_complement("kmer").alias("kmer"), dna.reverse_complement("around").alias("around"))
    cells = rows.union(back).select("kmer", F.posexplode(F.split("around", "")).alias("i", "base")).where(F.col("base").isin(*dna.BASES))
    return cells.groupBy("kmer", (F.col("i") - width).alias("col"), "base").agg(F.count("*").alias("n"))
