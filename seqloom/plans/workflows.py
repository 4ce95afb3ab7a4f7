"""Whole runs: discovering motifs, evaluating, clustering, combining, simulating, masking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna, ordered
from ..operators import background, cluster, em, kmers, metrics, positions, sampling, scan, thresholds
from ..operators.motifs import Motif, divergence
from .scratch import kept


@dataclass
class Discovery:
    """Settings of a discovery."""

    seed_length: int = 5
    motifs: int = 5
    order: int = 2
    rounds: int = 50
    fdr: float = 0.05
    max_length: int = 25
    min_length: int = 7
    min_count: int = 10
    overlap: float = 0.1
    least_auc: float = 0.5
    seed: int = 12345678


def base_frequencies(sequences: DataFrame) -> np.ndarray:
    p = {r["prefix"]: r["p"] for r in background.fit(sequences, 0).collect()}
    return np.array([p[b] for b in dna.BASES])


def controls(sequences: DataFrame, order: int = 2, fold: int = 1, seed: int = 1) -> DataFrame:
    """(seq_id, seq): ``fold`` random sequences as long as each sequence, from its set's background; ids are negative."""
    model = {r["prefix"]: r["p"] for r in background.fit(sequences, order).collect()}
    lengths = sequences.select("seq_id", F.length("seq").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(fold - 1))).alias("k"))
    return sampling.markov_sequences(lengths.select((-1 - (F.col("seq_id") * fold + F.col("k"))).alias("seq_id"), "len"), model, order, seed)


def clean_controls(negatives: DataFrame, sequences: DataFrame, k: int = 100, capped: bool = True) -> DataFrame:
    """The negatives that share no k-mer with the sequences; if capped, the first ones, up to twice as many as there are
    sequences, 1000 at least, and one more, as older programs count."""
    left = negatives.join(kmers.sharing(negatives, sequences, k), "seq_id", "left_anti")
    if not capped:
        return left
    most = max(1000, 2 * sequences.count())
    return ordered.numbered(left, "seq_id", "_number").where(F.col("_number") <= most).drop("_number")


def combinations(motifs: list[Motif], positives: DataFrame, negatives: DataFrame, reach: int = 20, strands: bool = False) -> DataFrame:
    """(motifs, n_pos, n_neg, auc) of every set of motifs, by the best sum of the motifs' profiles in a sequence."""
    rows = None
    for label, seqs in ((1, positives), (0, negatives)):
        part = cluster.profile_scores(seqs, motifs, reach, strands).withColumn("label", F.lit(label))
        rows = part if rows is None else rows.unionByName(part)
    return metrics.auc(kept(rows), "motifs")


def evaluate(motifs: list[Motif], positives: DataFrame, negatives: DataFrame, fdr: float = 0.001) -> DataFrame:
    """(motif, n_pos, n_neg, auc, mean_llr, hit_pos, hit_neg, z): all motifs in one scan of either set."""
    width = F.create_map(*(x for m in motifs for x in (F.lit(m.name), F.lit(len(m)))))[F.col("motif")]
    q = np.full(4, 0.25)
    limit = F.create_map(*(x for m in motifs for x in (F.lit(m.name), F.lit(thresholds.threshold(m, fdr, q)))))[F.col("motif")]
    rows = None
    for label, seqs in ((1, positives), (0, negatives)):
        part = scan.scan(seqs, motifs, None, best_only=True).withColumn("label", F.lit(label))
        rows = part if rows is None else rows.unionByName(part)
    rows = kept(rows)
    auc = metrics.auc(rows.select("motif", "score", "label"), "motif")
    llr = rows.where("label = 1").groupBy("motif").agg(F.avg(F.col("score") - width * F.log(F.lit(0.25))).alias("mean_llr"))
    hits = metrics.enrichment(rows.select("motif", "label", (F.col("score") >= limit).alias("hit"))).select("motif", "hit_pos", "hit_neg", "z")
    return auc.join(llr, "motif").join(hits, "motif")


def overlaps(motifs: list[Motif], sequences: DataFrame, fdr: float = 0.001, within: int = 5) -> dict[tuple[str, str], float]:
    q = base_frequencies(sequences)
    hits = scan.scan(sequences, motifs, {m.name: thresholds.threshold(m, fdr, q) for m in motifs})
    spaced = positions.spaced(hits, ["motif", "seq_id"], "pos", within).select("motif", "seq_id", "pos")
    return {(r["m1"], r["m2"]): r["ratio"] for r in positions.overlap_ratio(spaced, within).collect()}


def discover(sequences: DataFrame, negatives: DataFrame | None = None, settings: Discovery | None = None) -> list[Motif]:
    """Motifs by falling AUC: seeds by over-representation, widened and fitted together, evaluated and filtered by overlap."""
    s = settings or Discovery()
    model = background.fit(sequences if negatives is None else negatives, s.order)
    counts = kmers.count(sequences, s.seed_length).where(F.col("n") >= s.min_count)
    ranked = [r["kmer"] for r in kmers.over_represented(counts, model, s.seed_length, s.order, s.motifs**2).collect()]
    seeds = _without_mirrors(ranked)
    if not seeds:
        return []
    q = base_frequencies(sequences)
    states = [em.State(Motif.of_consensus(f"motif{i + 1}", k, 0.7)) for i, k in enumerate(seeds)]
    states = em.extend(sequences, states, q, least=s.min_length, most=s.max_length, alpha=s.fdr, rounds=s.max_length)
    states = em.fit(sequences, states, q, rounds=s.rounds)
    found = {x.motif.name: x.motif for x in states}
    judged = evaluate(list(found.values()), sequences, controls(sequences, s.order, 1, s.seed) if negatives is None else negatives)
    for r in judged.collect():
        found[r["motif"]].score = r["auc"]
    good = sorted((m for m in found.values() if m.score > s.least_auc), key=lambda m: (-m.score, m.name))
    if len(good) < 2:
        return good
    kept = cluster.greedy_filter([m.name for m in good], overlaps(good, sequences), s.overlap, s.motifs)[: s.motifs]
    return [m for m in good if m.name in set(kept)]


def _without_mirrors(ranked: list[str]) -> list[str]:
    flip, out = str.maketrans("ACGT", "TGCA"), []
    for k in ranked:
        if k.translate(flip)[::-1] not in out:
            out.append(k)
    return out


def clustered(motifs: list[Motif], linkage: str = "WPGMA", cut: float = 0.2) -> list[Motif]:
    """The best motif of each cluster by divergence."""
    d = np.array([[divergence(a, b) for b in motifs] for a in motifs])
    return cluster.representatives(motifs, cluster.hierarchical(d, linkage, cut))


def nearest(motifs: list[Motif], library: list[Motif], limit: int = 200, within: float = 0.24) -> list[tuple[str, str, float]]:
    """(motif, library motif, divergence) of the nearest library motifs of each."""
    out = []
    for m in motifs:
        found = sorted((divergence(m, o), o.name) for o in library)
        out += [(m.name, name, d) for d, name in found[:limit] if d <= within]
    return out


def masked(sequences: DataFrame, motifs: list[Motif], fdr: float = 0.001) -> DataFrame:
    """The sequences with all sites of the motifs overwritten by N."""
    q = base_frequencies(sequences)
    widths = F.create_map(*(x for m in motifs for x in (F.lit(m.name), F.lit(len(m)))))[F.col("motif")]
    hits = scan.scan(sequences, motifs, {m.name: thresholds.threshold(m, fdr, q) for m in motifs})
    sites = hits.groupBy("seq_id").agg(F.collect_list(F.struct("pos", widths.alias("width"))).alias("_sites"))
    rows = sequences.join(sites, "seq_id", "left")
    text = F.aggregate(F.coalesce("_sites", F.array().cast("array<struct<pos:int,width:int>>")), F.col("seq"), lambda s, x: dna.overwritten(s, x["pos"], x["width"], "N"))
    return rows.withColumn("seq", text).drop("_sites")
