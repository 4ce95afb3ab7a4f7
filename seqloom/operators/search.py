"""Searches over motif models and comparisons with answers: hill climbing, merging, dependency groups, verification."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna, stats
from ..functions.dna import BASES
from . import kmers
from .motifs import Motif, alignments, normalise

#: Sets of bases that a column may be set to: all but the empty one and the one of all four.
SUBSETS = ["".join(s) for k in (1, 2, 3) for s in itertools.combinations(BASES, k)]


def hill_climb(counts: DataFrame, start: str, background: dict[str, float], rounds: int = 20) -> tuple[list[str], float]:
    """Columns, as sets of bases, of the pattern with the best z-score of its count over its expectation, found by changing a
    column at a time.

    counts: (kmer, n) of the pattern's length, aggregated once; a round scores all changes of all columns in one plan.
    """
    width = len(start)
    total = counts.agg(F.sum("n")).first()[0] or 0
    columns = list(start)

    def scored(options: list[list[str]]) -> list[float]:
        fits = [F.sum(F.when(_matches(o), F.col("n")).otherwise(0)).alias(f"c{i}") for i, o in enumerate(options)]
        row = counts.agg(*fits).first()
        p = [float(np.prod([sum(background[b] for b in c) for c in o])) for o in options]
        return [stats.z_score(row[i] or 0, total, q) for i, q in enumerate(p)]

    def _matches(option):
        return F.col("kmer").rlike("^" + "".join(f"[{c}]" for c in option) + "$")

    best = scored([columns])[0]
    for _ in range(rounds):
        options = [[*columns[:i], s, *columns[i + 1 :]] for i in range(width) for s in SUBSETS if s != columns[i]]
        values = scored(options)
        top = int(np.argmax(values))
        if values[top] <= best + 1e-12:
            break
        best, columns = values[top], options[top]
    return columns, best


def of_subsets(name: str, columns: list[str], strength: float = 0.85) -> Motif:
    rows = [[strength / len(c) if b in c else (1 - strength) / (4 - len(c)) for b in BASES] for c in columns]
    return Motif(name, np.array(rows))


def merge(p: Motif, q: Motif, least: int = 5) -> Motif:
    """Two motifs at their best alignment, weighted by score; columns that one lacks are the other's."""
    found = [(d, strand, offset) for strand, m in ((0, q), (1, q.reverse_complement())) for offset, d in alignments(p.weights, m.weights, least)]
    _, strand, offset = min(found)
    other = q.reverse_complement() if strand else q
    low, high = min(0, offset), max(len(p), offset + len(other))
    total = np.zeros((high - low, 4))
    for m, at in ((p, 0), (other, offset)):
        total[at - low : at - low + len(m)] += max(m.score, 1e-9) * normalise(m.weights)
    return Motif(f"{p.name}+{q.name}", normalise(total), p.score + q.score, p.sites + q.sites)


def gapped_seeds(sequences: DataFrame, half: int, gap: int, limit: int) -> DataFrame:
    """(left, right, n, odds): pairs of k-mers a fixed gap apart, ranked by count over what their own counts let expect."""
    rows = kmers.explode(sequences, 2 * half + gap).select(F.substring("kmer", 1, half).alias("left"), F.substring("kmer", half + gap + 1, half).alias("right"))
    pairs = rows.groupBy("left", "right").agg(F.count("*").alias("n"))
    lefts, rights = pairs.groupBy("left").agg(F.sum("n").alias("nl")), pairs.groupBy("right").agg(F.sum("n").alias("nr"))
    total = pairs.agg(F.sum("n").alias("total"))
    scored = pairs.join(F.broadcast(lefts), "left").join(F.broadcast(rights), "right").crossJoin(F.broadcast(total))  # 4 ** half rows at most
    odds = F.round(F.col("n") * F.col("total") / (F.col("nl") * F.col("nr")), 6)
    return scored.where("n >= 10").select("left", "right", "n", odds.alias("odds")).orderBy(F.desc("odds"), "left", "right").limit(limit)


def spaced_seeds(sequences: DataFrame, mask: str, background: dict[str, float], limit: int, least: int = 10) -> DataFrame:
    """(seed, n, odds): the letters at a mask's kept places, with N at the others, ranked by count over what the bases' own
    frequencies let expect. The mask has as many gaps as it likes; 4 ** kept rows at most are shuffled by a task."""
    places = [i for i, c in enumerate(mask) if c == "1"]
    word = F.concat(*(F.substring("kmer", i + 1, 1) for i in places))
    rows = kmers.kmers_only(sequences, len(mask)).groupBy(word.alias("word")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    p = F.lit(1.0)
    for j in range(len(places)):
        letter = F.substring("word", j + 1, 1)
        p = p * F.when(letter == "A", background["A"]).when(letter == "C", background["C"]).when(letter == "G", background["G"]).otherwise(background["T"])
    seed = F.concat(*(F.substring("word", places.index(i) + 1, 1) if c == "1" else F.lit("N") for i, c in enumerate(mask)))
    scored = rows.where(F.col("n") >= least).crossJoin(F.broadcast(total)).select(seed.alias("seed"), "n", F.round(F.col("n") / (F.col("total") * p), 6).alias("odds"))
    return scored.orderBy(F.desc("odds"), "seed").limit(limit)


def recall(seeds: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """One row of how well seeds (kmer) of k letters find known sites (motif, site), a seed finding those that hold it: motifs,
    found ones and their share, families (the first three letters of a name) of found ones and motifs in each, pairs of a seed
    and a motif's site for each found motif, and for each matching seed."""
    sites = known.distinct().withColumn("seq_id", F.monotonically_increasing_id())
    parts = kmers.explode(sites.withColumnRenamed("site", "seq"), k, "motif").select("motif", "seq_id", "kmer").distinct()
    met = parts.join(F.broadcast(seeds.select("kmer").distinct()), "kmer")
    found = met.agg(F.countDistinct("motif").alias("n_found"), F.countDistinct("kmer").alias("n_seeds"), F.countDistinct(F.substring("motif", 1, 3)).alias("n_families"), F.count("*").alias("n_matches"))
    rows = known.agg(F.countDistinct("motif").alias("n_motifs")).crossJoin(found)
    ratio = lambda a, b, name: F.round(F.try_divide(F.col(a), F.col(b)), 6).alias(name)
    return rows.select("n_motifs", "n_found", "n_seeds", "n_families", "n_matches", ratio("n_found", "n_motifs", "recall"), ratio("n_found", "n_families", "a_family"), ratio("n_matches", "n_found", "abundance"), ratio("n_matches", "n_seeds", "redundancy"))


def cliques(edges: set[frozenset[int]], most: int = 4) -> list[frozenset[int]]:
    """The sets of two to ``most`` columns that are all joined by edges."""
    nodes = sorted({c for e in edges for c in e})
    return [frozenset(c) for k in range(2, most + 1) for c in itertools.combinations(nodes, k) if all(frozenset(p) in edges for p in itertools.combinations(c, 2))]


def diverse(ranked: list[str], distance: int, limit: int) -> list[str]:
    """Strings in order of merit, each kept if it differs from all kept ones, and their reverse complements, in ``distance`` places."""
    flip, kept = str.maketrans("ACGT", "TGCA"), []
    for s in ranked:
        if len(kept) < limit and all(sum(a != b for a, b in zip(s, t, strict=True)) >= distance for k in kept for t in (k, k.translate(flip)[::-1])):
            kept.append(s)
    return kept


def dependency_groups(score: dict[frozenset[int], float], budget: int) -> list[frozenset[int]]:
    """Disjoint groups of columns with the greatest sum of positive scores and at most ``budget`` columns: dynamic programming
    over sets of columns."""
    best: dict[frozenset[int], tuple[float, tuple[frozenset[int], ...]]] = {frozenset(): (0.0, ())}
    for group, value in sorted(score.items(), key=lambda g: sorted(g[0])):
        if value > 0:
            for used, (total, groups) in list(best.items()):
                if not used & group and len(used | group) <= budget and best.get(used | group, (-1.0,))[0] < total + value:
                    best[used | group] = total + value, (*groups, group)
    return list(max(best.values(), key=lambda b: (b[0], -len(b[1])))[1])


def verification(answers: DataFrame, predicted: DataFrame, within: int = 5) -> DataFrame:
    """(list_id, n_predicted, n_found, n_answers, precision, recall): predicted sites that lie within reach of an answer.

    Both sides have seq_id and pos; an answer is found once however many predictions are near it.
    """
    cell = lambda c: F.floor(c / within)
    a = answers.select("seq_id", F.col("pos").alias("a")).distinct().withColumn("cell", F.explode(F.array(*(cell(F.col("a")) + d for d in (-1, 0, 1)))))
    p = predicted.select("list_id", "seq_id", F.col("pos").alias("p")).distinct().withColumn("cell", cell(F.col("p")))
    met = p.join(a, ["seq_id", "cell"]).where(F.abs(F.col("a") - F.col("p")) < within)
    found = met.groupBy("list_id").agg(F.countDistinct("seq_id", "p").alias("hit"), F.countDistinct("seq_id", "a").alias("n_found"))
    sizes = p.groupBy("list_id").agg(F.count("*").alias("n_predicted"))
    total = answers.select("seq_id", "pos").distinct().agg(F.count("*").alias("n_answers"))
    rows = sizes.join(found, "list_id", "left").crossJoin(F.broadcast(total)).fillna(0, ["hit", "n_found"])
    return rows.select("list_id", "n_predicted", "n_found", "n_answers", (F.col("hit") / F.col("n_predicted")).alias("precision"), (F.col("n_found") / F.col("n_answers")).alias("recall"))


def smoothed_flank(p: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Base probabilities of a chain's columns given soft evidence: forward filtering and backward smoothing.

    p: [columns, 4] evidence; transition: [4, 4] of the next base; start: the first column's prior.
    """
    forward = np.zeros_like(p)
    state = start
    for i, row in enumerate(p):
        state = state * row
        state = state / state.sum()
        forward[i] = state
        state = state @ transition
    backward = np.ones(4)
    out = np.zeros_like(p)
    for i in range(len(p) - 1, -1, -1):
        out[i] = forward[i] * backward / (forward[i] * backward).sum()
        backward = transition @ (p[i] * backward)
        backward = backward / backward.sum()
    return out


def canonical_counts(sequences: DataFrame, k: int) -> DataFrame:
    return kmers.kmers_only(sequences, k).groupBy(dna.canonical("kmer").alias("kmer")).agg(F.count("*").alias("n"))
