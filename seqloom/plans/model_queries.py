"""Queries of motif models: alignment, EM, thresholds, clustering, simulation, priors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import dna, ordered, special
from ..operators import background, cluster, em, kmers, metrics, motifs, positions, sampling, scan, thresholds
from ..operators.motifs import Motif
from ..sources.corpus import letters, sequences, table
from .registry import over_seqs, query, rc, recursive, windows
from .scan_queries import BEST, HITS, LABELLED, MOTIFS, OVERLAP, SCORED, THRESHOLD, best, hits, labelled, motif_rows
from .scratch import kept
from .sequence_queries import model_sql

#: Motifs to compare with each other.
LIBRARY = [*MOTIFS, *(Motif.of_consensus(f"k{i + 1}", c) for i, c in enumerate(("TAATTAA", "GATTATC", "RTTAAYW", "CCGGTACC", "TTNNTTAA")))]
UNIFORM = np.full(4, 0.25)


def motif_values(name: str, rows: list[Motif]) -> str:
    values = ", ".join(f"('{m.name}', {len(m)}, {c}, {', '.join(f'{float(w)!r}::DOUBLE' for w in m.weights[c])})" for m in rows for c in range(len(m)))
    return f"{name} AS (SELECT * FROM (VALUES {values}) t(motif, width, col, a, c, g, t))"


def motif_frame(spark, rows: list[Motif]):
    return spark.createDataFrame([(m.name, len(m), c, *map(float, m.weights[c])) for m in rows for c in range(len(m))], "motif string, width int, col int, a double, c double, g double, t double")


_ALIGNED = """pairs AS (SELECT p.motif AS m1, q.motif AS m2, p.col - q.col AS shift, least(7, least(p.width, q.width) - 2) AS enough,
  sqrt((p.a - q.a) ** 2 + (p.c - q.c) ** 2 + (p.g - q.g) ** 2 + (p.t - q.t) ** 2) / sqrt(2.0) AS d FROM lib p JOIN {q} q ON p.motif < q.motif),
aligned AS (SELECT m1, m2, shift, avg(d) AS d FROM pairs GROUP BY m1, m2, shift, enough HAVING count(*) >= greatest(1, enough))"""


def aligned(left, right):
    """(m1, m2, shift, d): the mean distance of overlapping columns at every shift, of motifs in table form."""
    p, q = left.alias("p"), right.alias("q")
    d = F.sqrt(sum((F.pow(F.col(f"p.{b}") - F.col(f"q.{b}"), 2) for b in "acgt"), F.lit(0.0))) / F.sqrt(F.lit(2.0))
    rows = p.join(F.broadcast(q), F.col("p.motif") < F.col("q.motif")).select(
        F.col("p.motif").alias("m1"), F.col("q.motif").alias("m2"), (F.col("p.col") - F.col("q.col")).alias("shift"), F.least(F.lit(7), F.least("p.width", "q.width") - 2).alias("enough"), d.alias("d")
    )
    return rows.groupBy("m1", "m2", "shift", "enough").agg(F.avg("d").alias("d"), F.count("*").alias("n")).where("n >= greatest(1, enough)").select("m1", "m2", "shift", "d")


@query("j08_motif_alignment", f"WITH {motif_values('lib', LIBRARY)}, {_ALIGNED.format(q='lib')} SELECT m1, m2, shift, round(d, 6) AS d FROM aligned")
def j08(spark, sf_dir):
    lib = motif_frame(spark, LIBRARY)
    return aligned(lib, lib).select("m1", "m2", "shift", F.round("d", 6).alias("d"))


_BACK = motif_values("back", [m.reverse_complement() for m in LIBRARY])


_ALIGNED_BACK = _ALIGNED.format(q="back").replace("pairs AS", "rpairs AS").replace("FROM pairs", "FROM rpairs").replace("aligned AS", "raligned AS")
#: Common tables of the divergence of each two motifs: div(m1, m2, d).
DIVERGENCE = (motif_values("lib", LIBRARY), _BACK, _ALIGNED.format(q="lib").replace("pairs AS", "apairs AS").replace("FROM pairs", "FROM apairs"), _ALIGNED_BACK, "div AS (SELECT m1, m2, min(d) AS d FROM (SELECT * FROM aligned UNION ALL SELECT * FROM raligned) GROUP BY m1, m2)")


def _divergence_sql(then: str) -> str:
    return f"WITH {', '.join(DIVERGENCE)} {then}"


def divergences(spark):
    lib, back = motif_frame(spark, LIBRARY), motif_frame(spark, [m.reverse_complement() for m in LIBRARY])
    return aligned(lib, lib).union(aligned(lib, back)).groupBy("m1", "m2").agg(F.min("d").alias("d"))


@query("j09_strand_divergence", _divergence_sql("SELECT m1, m2, round(d, 6) AS d FROM div"))
def j09(spark, sf_dir):
    return divergences(spark).withColumn("d", F.round("d", 6))


_BOTH = "SELECT m, o, d FROM (SELECT m1 AS m, m2 AS o, d FROM div UNION ALL SELECT m2, m1, d FROM div)"


@query("j11_nearest_motifs", _divergence_sql(f"SELECT m, o, round(d, 6) AS d, k FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY d, o) AS k FROM ({_BOTH}) WHERE d <= 0.24) WHERE k <= 3"))
def j11(spark, sf_dir):
    """The three nearest motifs of each, within a divergence of 0.24."""
    from pyspark.sql import Window

    div = divergences(spark)
    both = div.select(F.col("m1").alias("m"), F.col("m2").alias("o"), "d").union(div.select(F.col("m2").alias("m"), F.col("m1").alias("o"), "d")).where("d <= 0.24")
    return both.withColumn("k", F.row_number().over(Window.partitionBy("m").orderBy("d", "o")).cast("long")).where("k <= 3").withColumn("d", F.round("d", 6))


#: The likeliest base of a column, the first of equal ones.
_TOP = "CASE WHEN a >= greatest(c, g, t) THEN 'A' WHEN c >= greatest(g, t) THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END"


@query(
    "c15_not_palindromes",
    f"""WITH {motif_values('lib', LIBRARY)}, {motif_values('back', [m.reverse_complement() for m in LIBRARY])},
pairs AS (SELECT p.motif, p.col - q.col AS shift, least(7, p.width - 2) AS enough, sqrt((p.a - q.a) ** 2 + (p.c - q.c) ** 2 + (p.g - q.g) ** 2 + (p.t - q.t) ** 2) / sqrt(2.0) AS d FROM lib p JOIN back q ON p.motif = q.motif),
own AS (SELECT motif, min(d) AS d FROM (SELECT motif, avg(d) AS d FROM pairs GROUP BY motif, shift, enough HAVING count(*) >= greatest(1, enough)) GROUP BY motif)
SELECT motif, string_agg({_TOP}, '' ORDER BY col) AS best, (SELECT string_agg({_TOP}, '' ORDER BY col) FROM back b WHERE b.motif = lib.motif) AS rc_best, round(any_value(d), 6) AS d FROM lib JOIN own USING (motif) WHERE d >= 0.18 GROUP BY motif""",
)
def c15(spark, sf_dir):
    """Motifs that differ from their own reverse complement by 0.18 or more, with it."""
    rows = []
    for m in LIBRARY:
        d = min(x for _, x in motifs.alignments(m.weights, m.reverse_complement().weights))
        if d >= 0.18:
            rows.append((m.name, m.best(), m.reverse_complement().best(), float(round(d, 6))))
    return spark.createDataFrame(rows, "motif string, best string, rc_best string, d double")


_EM = (
    *SCORED,
    "bases AS (SELECT seq_id, unnest(string_split(seq, '')) AS base, unnest(range(0, length(seq))) AS place FROM seqs)",
    "ratio AS (SELECT seq_id, pos, len, 0.25 / (len - width + 1) * exp(least(a - width * ln(0.25), 10)) AS f, 0.25 / (len - width + 1) * exp(least(b - width * ln(0.25), 10)) AS r FROM scored WHERE motif = 'm1')",
    "post AS (SELECT seq_id, pos, f / (0.5 + sum(f + r) OVER (PARTITION BY seq_id)) AS f, r / (0.5 + sum(f + r) OVER (PARTITION BY seq_id)) AS r FROM ratio)",
    "cells AS (SELECT CAST(place - pos AS INTEGER) AS col, base, f AS z FROM post JOIN bases USING (seq_id) WHERE place >= pos AND place < pos + 6 UNION ALL SELECT CAST(5 - (place - pos) AS INTEGER), translate(base, 'ACGT', 'TGCA'), r FROM post JOIN bases USING (seq_id) WHERE place >= pos AND place < pos + 6)",
)


@query("e01_em_step", over_seqs("SELECT col, base, round(sum(z), 4) AS n FROM cells GROUP BY col, base", *_EM))
def e01(spark, sf_dir):
    """Expected base counts of a motif after one E-step with at most one site in a sequence."""
    counts, _, _ = em.expected_counts(sequences(spark, sf_dir), [em.State(MOTIFS[0])], UNIFORM)["m1"]
    return spark.createDataFrame([(c, b, round(float(counts[c, k]), 4)) for c in range(len(counts)) for k, b in enumerate("ACGT")], "col int, base string, n double")


def model_rows(spark, states):
    rows = [(s.motif.name, c, *(round(float(w), 6) for w in s.motif.weights[c]), round(s.share, 6)) for s in states for c in range(len(s.motif))]
    return spark.createDataFrame(rows, "motif string, col int, a double, c double, g double, t double, share double")


@query("e01_extending_em")
def e01_extending(spark, sf_dir):
    """Seeds widened column by column and then fitted, all seeds in the same rounds."""
    seqs = sequences(spark, sf_dir)
    seeds = kmers.over_represented(kmers.count(seqs, 6), background.fit(seqs, 2), 6, 2, 3).collect()
    states = [em.State(Motif.of_consensus(f"s{i + 1}", r["kmer"], 0.7)) for i, r in enumerate(seeds)]
    wide = em.extend(seqs, states, UNIFORM, rounds=4, most=12)
    return model_rows(spark, em.fit(seqs, wide, UNIFORM, rounds=5))


@query("e02_resampled_em")
def e02(spark, sf_dir):
    """EM over a sample of windows, drawn by likelihood and weighted by the inverse of their chance."""
    state, _ = em.resampled(sequences(spark, sf_dir), Motif.of_consensus("m2", "GATTATC", 1.0), UNIFORM, kept)
    return model_rows(spark, [state])


@query("e03_sequence_posterior", over_seqs("SELECT seq_id, round(sum(f + r), 6) AS p FROM post GROUP BY seq_id", *_EM))
def e03(spark, sf_dir):
    """The probability that a sequence holds a site at all: window ratios normalised within each sequence."""
    m = MOTIFS[0]
    seqs = sequences(spark, sf_dir).select("seq_id", "seq")
    rows = one_strand(seqs, m).union(one_strand(seqs, m.reverse_complement()))
    odds = F.exp(F.least(F.col("score") - len(m) * F.log(F.lit(0.25)), F.lit(em.CAP)))
    sums = rows.groupBy("seq_id").agg((F.sum(odds) * 0.25 / (F.count("*") / 2)).alias("s"))  # as many windows on each strand
    return sums.select("seq_id", F.round(F.col("s") / (0.5 + F.col("s")), 6).alias("p"))


def one_strand(seqs, motif):
    """(seq_id, score) of all windows of the forward strand, as a sum over a k-mer lookup: a plan of built-in operators."""
    width = len(motif)
    logs = motif.logs
    score = sum((F.element_at(F.create_map(*(x for k, b in enumerate("ACGT") for x in (F.lit(b), F.lit(float(logs[c, k]))))), F.substring("kmer", c + 1, 1)) for c in range(width)), F.lit(0.0))
    return kmers.explode(seqs, width).select("seq_id", score.alias("score"))


@query(
    "e04_prior_cutoff",
    over_seqs("SELECT round(score, 6) AS score, n_pos, n_neg, round(gain, 6) AS gain FROM (SELECT score, CAST(tp AS BIGINT) AS n_pos, CAST(fp AS BIGINT) AS n_neg, tp / p - fp / n AS gain FROM (SELECT score, sum(l) OVER (ORDER BY score DESC) AS tp, sum(k) OVER (ORDER BY score DESC) AS fp, sum(l) OVER () AS p, sum(k) OVER () AS n FROM (SELECT score, sum(label) AS l, sum(1 - label) AS k FROM labelled WHERE motif = 'm2' GROUP BY score))) ORDER BY round(gain, 9) DESC, e04.score DESC LIMIT 1".replace("e04.score", "score"), *LABELLED),
)
def e04(spark, sf_dir):
    """The cut-off that separates labels best: prefix sums over the ranking instead of a scan for each cut-off."""
    rows = metrics.roc(kept(labelled(spark, sf_dir, "m2").select("score", "label"))).withColumn("gain", F.col("tpr") - F.col("fpr"))
    top = rows.orderBy(F.desc(F.round("gain", 9)), F.desc("score")).limit(1)
    return top.select(F.round("score", 6).alias("score"), F.col("tp").alias("n_pos"), F.col("fp").alias("n_neg"), F.round("gain", 6).alias("gain"))


@query("e05_log_odds_sums", over_seqs("SELECT motif, round(sum(score - width * ln(0.25)), 4) AS total, round(max(score - width * ln(0.25)), 6) AS top FROM best GROUP BY motif", *BEST))
def e05(spark, sf_dir):
    found = kept(best(spark, sf_dir))
    rows = None
    for m in MOTIFS:
        part = em.log_odds_by_sequence(found.where(F.col("motif") == m.name), len(m))
        rows = part if rows is None else rows.union(part)
    return rows.select("motif", F.round("total", 4).alias("total"), F.round("top", 6).alias("top"))


@query(
    "e09_mixing_share",
    recursive(
        over_seqs(
            "SELECT 'm1' AS motif, round((lo + hi) / 2, 6) AS share FROM halved WHERE k = 50",
            *BEST,
            "ratios AS (SELECT exp(score - 6 * ln(0.25)) AS r FROM best WHERE motif = 'm1')",
            # where the slope of the log-likelihood changes its sign
            "halved AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL SELECT k + 1, CASE WHEN s > 0 THEN mid ELSE lo END, CASE WHEN s > 0 THEN hi ELSE mid END FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid, (SELECT sum((r - 1) / (1 - (lo + hi) / 2 + (lo + hi) / 2 * r)) FROM ratios) AS s FROM halved WHERE k < 50))",
        )
    ),
)
def e09(spark, sf_dir):
    """The share of sequences with a site, by Newton steps on an aggregate."""
    rows = best(spark, sf_dir, "m1").select(F.exp(F.col("score") - 6 * F.log(F.lit(0.25))).alias("ratio"))
    return spark.createDataFrame([("m1", round(em.mixing_share(kept(rows), "ratio"), 6))], "motif string, share double")


@query("e09_logistic_combiner")
def e09_logistic(spark, sf_dir):
    """How the motifs' best scores together tell labels apart: the weight of each, and the intercept."""
    rows = labelled(spark, sf_dir).groupBy("seq_id", "label").pivot("motif", [m.name for m in MOTIFS]).agg(F.max("score"))
    rows = kept(rows.where(" AND ".join(f"{m.name} IS NOT NULL" for m in MOTIFS)))
    w = em.logistic(rows, [m.name for m in MOTIFS], "label")
    return spark.createDataFrame([(n, round(float(x), 6)) for n, x in zip([*(m.name for m in MOTIFS), "intercept"], w, strict=True)], "term string, weight double")


@query("e09_negative_binomial_mixture")
def e09_mixture(spark, sf_dir):
    """Two negative binomials of how often the least selective motif hits a sequence."""
    counts = kept(hits(spark, sf_dir, "m3").groupBy("seq_id").agg(F.count("*").alias("n")))
    parts = em.negative_binomial_mixture(counts, "n")
    return spark.createDataFrame([(i, *(round(x, 6) for x in c)) for i, c in enumerate(parts)], "component int, share double, r double, p double")


@query("e10_negative_binomial", "SELECT doc_id, round(lgamma(n_chars + 5.0) - lgamma(n_chars + 1.0) - lgamma(5.0) + 5 * ln(0.002) + n_chars * ln(0.998), 4) AS logp FROM documents")
def e10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(special.negative_binomial(F.col("n_chars").cast("double"), 5.0, 0.002), 4).alias("logp"))


@query("e12_mixed_background", over_seqs("SELECT prefix, round(0.9 * p + 0.1 * 0.25, 9) AS p FROM model", model_sql(1)))
def e12(spark, sf_dir):
    return background.fit(sequences(spark, sf_dir), 1).select("prefix", F.round(0.9 * F.col("p") + 0.1 * 0.25, 9).alias("p"))


@query(
    "a11_motif_of_sites",
    over_seqs("SELECT motif, CAST(col AS INTEGER) AS col, base, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY motif, col), 6) AS w FROM (SELECT motif, i AS col, substr(site, i + 1, 1) AS base FROM (SELECT motif, site, unnest(range(0, length(site))) AS i FROM (SELECT motif, CASE WHEN reverse THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS site FROM (SELECT motif, reverse, substr(seq, pos + 1, width) AS s FROM hits JOIN seqs USING (seq_id))))) GROUP BY motif, i, base".replace("GROUP BY motif, i, base", "GROUP BY motif, col, base"), *HITS),
)
def a11(spark, sf_dir):
    """Base frequencies of each motif's hits, aligned on the motif's strand."""
    from pyspark.sql import Window

    rows = scan.scan(sequences(spark, sf_dir), MOTIFS, THRESHOLD, sites=True)
    s = F.col("site")
    cells = rows.select("motif", F.posexplode(F.split(F.when(F.col("reverse"), dna.reverse_complement(s)).otherwise(s), "")).alias("col", "base")).where("base <> ''")
    counts = cells.groupBy("motif", "col", "base").agg(F.count("*").alias("n"))
    return counts.select("motif", "col", "base", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("motif", "col")), 6).alias("w"))


@query(
    "a12_normalise",
    "SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN s > 0 THEN (greatest(v[i + 1], 0) + 1e-14) / s ELSE 1.0 / len(v) END, 6) AS p FROM (SELECT vec_id, v, list_sum(list_transform(v, lambda x: greatest(x, 0))) AS s, unnest(range(0, len(v))) AS i FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings))",
)
def a12(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("s", F.aggregate("v", F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0))))
    cells = rows.select("vec_id", "s", F.size("v").alias("n"), F.posexplode("v").alias("i", "x"))
    return cells.select("vec_id", "i", F.round(F.when(F.col("s") > 0, (F.greatest("x", F.lit(0.0)) + motifs.TINY) / F.col("s")).otherwise(1.0 / F.col("n")), 6).alias("p"))


@query("a13_prefix_sums", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id) - value, 3) AS before FROM events")
def a13(spark, sf_dir):
    rows = ordered.running_sums(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", ["value"])
    return rows.select("event_id", F.round("before_value", 3).alias("before"))


@query("a14_information", f"WITH {motif_values('lib', LIBRARY)} SELECT motif, col, round(2 + a * log2(a) + c * log2(c) + g * log2(g) + t * log2(t), 6) AS bits, round(a * ln(a / 0.25) + c * ln(c / 0.25) + g * ln(g / 0.25) + t * ln(t / 0.25), 6) AS kl FROM lib")
def a14(spark, sf_dir):
    lib = motif_frame(spark, LIBRARY)
    bits = sum((F.col(b) * F.log2(b) for b in "acgt"), F.lit(2.0))
    kl = sum((F.col(b) * F.log(F.col(b) / 0.25) for b in "acgt"), F.lit(0.0))
    return lib.select("motif", "col", F.round(bits, 6).alias("bits"), F.round(kl, 6).alias("kl"))


_BITS = "(2 + a * log2(a) + c * log2(c) + g * log2(g) + t * log2(t))"
_IUPAC = "CASE (CASE WHEN a > 0.26 THEN 'A' ELSE '' END || CASE WHEN c > 0.26 THEN 'C' ELSE '' END || CASE WHEN g > 0.26 THEN 'G' ELSE '' END || CASE WHEN t > 0.26 THEN 'T' ELSE '' END) " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in motifs.CODES.items()) + " ELSE 'N' END"
_CORE = f"CASE WHEN width <= 8 OR max({_BITS}) <= 0.4 THEN 0 ELSE min(col) FILTER ({_BITS} > 0.4) END AS head, CASE WHEN width <= 8 OR max({_BITS}) <= 0.4 THEN width ELSE max(col) FILTER ({_BITS} > 0.4) + 1 END AS tail"


@query("c12_consensus", f"WITH {motif_values('lib', LIBRARY)} SELECT motif, string_agg({_IUPAC}, '' ORDER BY col) AS consensus, string_agg({_TOP}, '' ORDER BY col) AS best, {_CORE} FROM lib GROUP BY motif, width")
def c12(spark, sf_dir):
    return spark.createDataFrame([(m.name, m.consensus(), m.best(), *m.core()) for m in LIBRARY], "motif string, consensus string, best string, head int, tail int")


@query("c13_reverse_complement", f"WITH {motif_values('lib', LIBRARY)} SELECT motif, width - 1 - col AS col, t AS a, g AS c, c AS g, a AS t FROM lib")
def c13(spark, sf_dir):
    rows = [m.reverse_complement() for m in LIBRARY]
    return motif_frame(spark, rows).drop("width")


_WIDE = [Motif.of_consensus("wide", "NNTAATTANN"), *LIBRARY]


@query("f08_trimmed", f"WITH {motif_values('lib', _WIDE)}, ends AS (SELECT motif, width, {_CORE} FROM lib GROUP BY motif, width) SELECT motif, width, tail - head AS kept, string_agg({_IUPAC}, '' ORDER BY col) AS consensus FROM lib JOIN ends USING (motif, width) WHERE col >= head AND col < tail GROUP BY motif, width, head, tail")
def f08(spark, sf_dir):
    rows = _WIDE
    return spark.createDataFrame([(m.name, len(m), len(m.trimmed()), m.trimmed().consensus()) for m in rows], "motif string, width int, kept int, consensus string")


_WIDEST = max(map(len, MOTIFS))
#: The distribution of the sums of rounded scores, a column at a time: tails(motif, s, tail).
_SCORES = (
    "steps AS (SELECT motif, width, col, CAST(round(f * 1000) AS BIGINT) AS step, p AS q FROM motifs JOIN model ON prefix = base)",
    "d0 AS (SELECT DISTINCT motif, width, 0::BIGINT AS s, 1.0::DOUBLE AS p FROM motifs)",
    *(f"d{i + 1} AS (SELECT d.motif, d.width, s + step AS s, sum(p * q) AS p FROM d{i} d JOIN steps t ON t.motif = d.motif AND col = {i} GROUP BY ALL UNION ALL SELECT motif, width, s, p FROM d{i} WHERE width <= {i})" for i in range(_WIDEST)),
    f"tails AS (SELECT motif, s, sum(p) OVER (PARTITION BY motif ORDER BY s DESC) AS tail, max(s) OVER (PARTITION BY motif) AS top FROM d{_WIDEST})",
)


@query(
    "t06_exact_threshold",
    over_seqs(
        "SELECT motif, rate, coalesce(min(s) FILTER (tail <= rate), any_value(top) + 1) / 1000.0 AS threshold, round(coalesce(max(tail) FILTER (tail <= rate), 0), 9) AS false_rate FROM tails, (SELECT unnest([0.05::DOUBLE, 0.01::DOUBLE, 0.001::DOUBLE]) AS rate) GROUP BY motif, rate",
        motif_rows(),
        model_sql(0),
        *_SCORES,
    ),
)
def t06_exact(spark, sf_dir):
    """Thresholds by the distribution of scores, rounded to 1/1000 a column, under the sequences' base frequencies."""
    p = {r["prefix"]: r["p"] for r in background.fit(sequences(spark, sf_dir), 0).collect()}
    q = [p[b] for b in "ACGT"]
    rows = [(m.name, rate, thresholds.threshold(m, rate, q)) for m in MOTIFS for rate in (0.05, 0.01, 0.001)]
    return spark.createDataFrame([(n, r, t, round(thresholds.false_rate(next(m for m in MOTIFS if m.name == n), t, q), 9)) for n, r, t in rows], "motif string, rate double, threshold double, false_rate double")


def instances_sql(mass: float, rows: list[Motif]) -> list[str]:
    """Common tables: every string of the motifs with its probability, and those that ``mass`` takes: taken(motif, kmer, p)."""
    widest = max(map(len, rows))
    letters = "letters AS (SELECT motif, width, col, b.base, ln((CASE b.base WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END + 1e-14) / (a + c + g + t)) AS l FROM lib, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) b)"
    grown = [f"e{i + 1} AS (SELECT e.motif, e.width, kmer || base AS kmer, e.l + x.l AS l FROM e{i} e JOIN letters x ON x.motif = e.motif AND col = {i} UNION ALL SELECT motif, width, kmer, l FROM e{i} WHERE width <= {i})" for i in range(widest)]
    return [
        motif_values("lib", rows),
        letters,
        "e0 AS (SELECT DISTINCT motif, width, '' AS kmer, 0.0::DOUBLE AS l FROM lib)",
        *grown,
        f"taken AS (SELECT motif, kmer, exp(l) AS p FROM (SELECT motif, kmer, l, coalesce(sum(exp(l)) OVER (PARTITION BY motif ORDER BY round(l, 8) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-7 PRECEDING), 0) AS before FROM e{widest}) WHERE before < {mass})",
    ]


@query(
    "t08_top_instances",
    over_seqs("SELECT motif, taken.kmer, round(p, 9) AS p, coalesce(n, 0) AS n FROM taken LEFT JOIN (SELECT kmer, count(*) AS n FROM kmers6 GROUP BY kmer UNION ALL SELECT kmer, count(*) FROM kmers7 GROUP BY kmer) k USING (kmer)", windows(6), windows(7), *instances_sql(0.5, MOTIFS[:2])),
)
def t08(spark, sf_dir):
    """The likeliest strings of each motif up to half of its probability, with their counts in the sequences."""
    rows = [(m.name, s, p) for m in MOTIFS[:2] for s, p in thresholds.instances(m, 0.5)]
    wanted = spark.createDataFrame(rows, "motif string, kmer string, p double")
    counts = None
    for k in sorted({len(m) for m in MOTIFS[:2]}):
        part = kmers.count(sequences(spark, sf_dir), k)
        counts = part if counts is None else counts.union(part)
    return wanted.join(counts, "kmer", "left").select("motif", "kmer", F.round("p", 9).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))


def overlaps(spark, sf_dir):
    rows = positions.spaced(hits(spark, sf_dir), ["motif", "seq_id"], "pos", 5).select("motif", "seq_id", "pos")
    return positions.overlap_ratio(kept(rows), 5).collect()


@query("c01_greedy_clusters", recursive(over_seqs(
    "SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS place, name AS motif FROM (SELECT unnest(kept) AS name, unnest(range(0, len(kept))) AS i FROM (SELECT kept FROM (SELECT t, kept FROM filtered WHERE i = 4 ORDER BY t) WHERE len(kept) >= 2 OR 0.1 * pow(1.2, t) >= 1 ORDER BY t LIMIT 1))",
    *OVERLAP,
    # each limit of 0.1 x 1.2 ** t, and the motifs one after the other
    "filtered AS (SELECT t, 1 AS i, []::VARCHAR[] AS kept FROM (SELECT unnest(range(0, 14)) AS t) UNION ALL SELECT t, i + 1, CASE WHEN (SELECT coalesce(max(ratio), 0) FROM overlap WHERE (m1 = 'm' || i AND list_contains(kept, m2)) OR (m2 = 'm' || i AND list_contains(kept, m1))) <= 0.1 * pow(1.2, t) THEN list_append(kept, 'm' || i) ELSE kept END FROM filtered WHERE i < 4)",
)))
def c01(spark, sf_dir):
    ratio = {(r["m1"], r["m2"]): r["ratio"] for r in overlaps(spark, sf_dir)}
    kept = cluster.greedy_filter([m.name for m in MOTIFS], ratio, 0.1, 2)
    return spark.createDataFrame([(i, n) for i, n in enumerate(kept)], "place int, motif string")


@query("c03_hierarchical_clusters")
def c03(spark, sf_dir):
    d = {(r["m1"], r["m2"]): r["d"] for r in divergences(spark).collect()}
    names = [m.name for m in LIBRARY]
    matrix = np.array([[0.0 if a == b else d.get((a, b), d.get((b, a), 1.0)) for b in names] for a in names])
    rows = [(linkage, i, names[k]) for linkage in ("SINGLE", "COMPLETE", "UPGMA", "WPGMA", "UPGMC", "WPGMC", "WARD") for i, c in enumerate(cluster.hierarchical(matrix, linkage, 0.3)) for k in c]
    return spark.createDataFrame(rows, "linkage string, cluster int, motif string")


@query("c04_pair_scores", recursive(over_seqs("SELECT m1, m2, n_near, ratio FROM overlap", *OVERLAP)))
def c04(spark, sf_dir):
    rows = [(r["m1"], r["m2"], r["n_near"], r["ratio"]) for r in overlaps(spark, sf_dir)]
    return spark.createDataFrame(rows, "m1 string, m2 string, n_near long, ratio double")


@query(
    "c05_overlap_and_divergence_filter",
    recursive(
        over_seqs(
            "SELECT name AS motif, CAST(width AS DOUBLE) AS score FROM (SELECT unnest(kept) AS name FROM judged WHERE k = 9) JOIN (SELECT DISTINCT motif AS name, width FROM lib) USING (name)",
            *OVERLAP,
            *DIVERGENCE,
            "ranked AS (SELECT motif, row_number() OVER (ORDER BY width DESC, motif) AS k FROM (SELECT DISTINCT motif, width FROM lib))",
            """judged AS (SELECT 1::BIGINT AS k, []::VARCHAR[] AS kept UNION ALL SELECT j.k + 1, CASE WHEN (SELECT coalesce(max(ratio), 0) FROM overlap WHERE (m1 = r.motif AND list_contains(j.kept, m2)) OR (m2 = r.motif AND list_contains(j.kept, m1))) <= 0.5
  AND (SELECT coalesce(min(d), 1) FROM div WHERE (m1 = r.motif AND list_contains(j.kept, m2)) OR (m2 = r.motif AND list_contains(j.kept, m1))) >= 0.09 THEN list_append(j.kept, r.motif) ELSE j.kept END FROM judged j JOIN ranked r USING (k))""",
        )
    ),
)
def c05(spark, sf_dir):
    ratio = {(r["m1"], r["m2"]): r["ratio"] for r in overlaps(spark, sf_dir)}
    scored = [Motif(m.name, m.weights, float(len(m))) for m in LIBRARY]
    return spark.createDataFrame([(m.name, m.score) for m in cluster.divergence_filter(scored, ratio, 0.5, 0.09)], "motif string, score double")


_WORD = "substr(kmer, 2, 1) || substr(kmer, 5, 1)"


@query(
    "c07_column_dependence",
    over_seqs(f"SELECT word, CAST(sum(n) AS BIGINT) AS n, round(sum(p), 6) AS p, round(sum(q), 6) AS q, round(sum(p) * ln(sum(p) / sum(q)), 6) AS kl FROM (SELECT CASE WHEN row_number() OVER (ORDER BY n DESC, w) <= 7 THEN w ELSE 'N' END AS word, n, p, q FROM (SELECT w, j.n, j.n / t.total AS p, (x.n / t.total) * (y.n / t.total) AS q FROM (SELECT {_WORD} AS w, count(*) AS n FROM kmers6 GROUP BY 1) j JOIN (SELECT substr(kmer, 2, 1) AS b, count(*) AS n FROM kmers6 GROUP BY 1) x ON x.b = substr(w, 1, 1) JOIN (SELECT substr(kmer, 5, 1) AS b, count(*) AS n FROM kmers6 GROUP BY 1) y ON y.b = substr(w, 2, 1), (SELECT count(*) AS total FROM kmers6) t)) GROUP BY word", windows(6)),
)
def c07(spark, sf_dir):
    rows = cluster.dependence(kmers.kmers_only(sequences(spark, sf_dir), 6).withColumnRenamed("kmer", "site"), [1, 4], 7)
    return rows.select("word", "n", *(F.round(c, 6).alias(c) for c in ("p", "q", "kl")))


@query(
    "c09_similar_sequences",
    f"""WITH items AS (SELECT item_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark),
k AS (SELECT DISTINCT seq_id, least(kmer, {rc('kmer')}) AS kmer FROM (SELECT seq_id, substr(seq, pos + 1, 10) AS kmer FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 9)) AS pos FROM items))),
met AS (SELECT x.seq_id AS a, y.seq_id AS b, count(*) AS n_shared FROM k x JOIN k y USING (kmer) WHERE x.seq_id < y.seq_id GROUP BY 1, 2 HAVING count(*) >= 2),
texts AS (SELECT a, b, x.seq AS x, y.seq AS y, 0 AS strand FROM met JOIN items x ON x.seq_id = a JOIN items y ON y.seq_id = b UNION ALL SELECT a, b, x.seq, {rc('y.seq')}, 1 FROM met JOIN items x ON x.seq_id = a JOIN items y ON y.seq_id = b),
cells AS (SELECT a, b, strand, i - j AS d, i FROM (SELECT *, unnest(range(1, length(y) + 1)) AS j FROM (SELECT *, unnest(range(1, length(x) + 1)) AS i FROM texts)) WHERE substr(x, i, 1) = substr(y, j, 1)),
runs AS (SELECT a, b, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, strand, d ORDER BY i) AS g FROM cells) GROUP BY a, b, strand, d, g)
SELECT a, b, n_shared, CAST(max(n) AS INTEGER) AS longest FROM runs JOIN met USING (a, b) GROUP BY a, b, n_shared""",
)
def c09(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), letters("text").alias("seq"))
    return cluster.similar_sequences(items, 10, 2)


_SETS = " UNION ALL ".join(f"SELECT '{'+'.join(s)}' AS motifs, seq_id, label, round(sum(score), 9) AS score FROM labelled WHERE motif IN ({', '.join(repr(x) for x in s)}) GROUP BY seq_id, label" for s in (["m1"], ["m2"], ["m3"], ["m1", "m2"], ["m1", "m3"], ["m2", "m3"], ["m1", "m2", "m3"]))


@query(
    "c10_best_combination",
    over_seqs(f"SELECT motifs, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auc FROM (SELECT motifs, label, rank() OVER (PARTITION BY motifs ORDER BY score) + (count(*) OVER (PARTITION BY motifs, score) - 1) / 2.0 AS r FROM sets) GROUP BY motifs", *LABELLED, f"sets AS ({_SETS})"),
)
def c10(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("label"))
    return cluster.combine(best(spark, sf_dir).select("seq_id", "motif", "score"), [m.name for m in MOTIFS], labels).withColumn("auc", F.round("auc", 6))


def _profiles_sql(strands: bool) -> list[str]:
    """Common tables: the best window of a motif within 20 of each place, on either strand or on each: sums(motifs, seq_id, score)."""
    kinds = "[{'s': 0, 'v': a}, {'s': 1, 'v': b}]" if strands else "[{'s': 0, 'v': greatest(a, b)}]"
    names = [[m.name for i, m in enumerate(MOTIFS) if k >> i & 1] for k in range(1, 8)]
    one = " UNION ALL ".join(f"SELECT '{'+'.join(s)}' AS motifs, seq_id, max(total) AS score FROM (SELECT seq_id, strand, pos, sum(top) AS total FROM tops WHERE motif IN ({', '.join(repr(x) for x in s)}) AND top IS NOT NULL GROUP BY ALL HAVING count(*) = {len(s)}) GROUP BY seq_id" for s in names)
    return [
        *SCORED,
        f"sided AS (SELECT seq_id, motif, pos, unnest({kinds}) AS x FROM scored)",
        f"cells AS (SELECT seq_id, motif, strand, unnest(range(0, length(seq))) AS pos FROM seqs, (SELECT DISTINCT motif FROM motifs), (SELECT unnest([{'0, 1' if strands else '0'}]) AS strand))",
        "tops AS (SELECT c.seq_id, c.motif, c.strand, c.pos, max(s.x.v) OVER (PARTITION BY c.seq_id, c.motif, c.strand ORDER BY c.pos RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS top FROM cells c LEFT JOIN sided s ON s.seq_id = c.seq_id AND s.motif = c.motif AND s.x.s = c.strand AND s.pos = c.pos)",
        f"sums AS ({one})",
    ]


def _profile_auc(strands: bool) -> str:
    ranked = "SELECT motifs, quality AS label, rank() OVER (PARTITION BY motifs ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY motifs, round(score, 9)) - 1) / 2.0 AS r FROM sums JOIN labels ON doc_id = seq_id"
    return over_seqs(f"SELECT motifs, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auc FROM ({ranked}) GROUP BY motifs", *_profiles_sql(strands))


def combined(spark, sf_dir, strands):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("label"))
    rows = kept(cluster.profile_scores(sequences(spark, sf_dir), MOTIFS, 20, strands).join(labels, "seq_id"))
    return metrics.auc(rows, "motifs").withColumn("auc", F.round("auc", 6))


@query("c10_window_profiles", _profile_auc(False))
def c10_windows(spark, sf_dir):
    """Sets of motifs by the best sum of their profiles' window maxima."""
    return combined(spark, sf_dir, False)


@query("c10_one_strand", _profile_auc(True))
def c10_strand(spark, sf_dir):
    """The same with all windows of a sum on one strand."""
    return combined(spark, sf_dir, True)


@query("r01_markov_sequences")
def r01(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    model = {r["prefix"]: r["p"] for r in background.fit(seqs, 2).collect()}
    return sampling.markov_sequences(seqs.select("seq_id", F.length("seq").alias("len")), model, 2, 5)


@query("r03_weighted_draws", "SELECT CAST(draw AS BIGINT) AS draw, seq_id FROM (SELECT draw, CAST(('0x' || substr(md5('3:' || draw), 1, 12)) AS BIGINT) / 281474976710656.0 * total AS at FROM (SELECT unnest(range(0, 500)) AS draw), (SELECT CAST(sum(n_chars) AS DOUBLE) AS total FROM documents)) JOIN (SELECT doc_id AS seq_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS a, sum(n_chars) OVER (ORDER BY doc_id) AS b FROM documents) ON at >= a AND at < b".replace(" AS at FROM", " AS place FROM").replace("ON at >= a AND at < b", "ON place >= a AND place < b"))
def r03(spark, sf_dir):
    """500 documents drawn with replacement in proportion to their length."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("n_chars").cast("double").alias("w"))
    return sampling.weighted_draws(rows, "w", 500, 3, "seq_id")


def planted_sql(motif: Motif, share: float, seed: int) -> list[str]:
    """Common tables: planted(seq_id, site, pos, reverse)."""
    u = lambda what: f"(CAST(('0x' || substr(md5('{seed}:' || seq_id || ':{what}'), 1, 12)) AS BIGINT) / 281474976710656.0)"
    site = lambda m: " || ".join(f"CASE WHEN {u(c)} < {row[0]!r}::DOUBLE THEN 'A' WHEN {u(c)} < {row[1]!r}::DOUBLE THEN 'C' WHEN {u(c)} < {row[2]!r}::DOUBLE THEN 'G' ELSE 'T' END" for c, row in enumerate(sampling.running(m).tolist()))
    chosen = f"(length(seq) >= {len(motif)} AND {u('share')} < {share})"
    return [
        f"placed AS (SELECT seq_id, CASE WHEN {chosen} THEN CAST(floor({u('pos')} * (length(seq) - {len(motif) - 1})) AS INTEGER) END AS pos, CASE WHEN {chosen} THEN {u('strand')} < 0.5 END AS reverse FROM seqs)",
        f"planted AS (SELECT seq_id, CASE WHEN reverse THEN {site(motif.reverse_complement())} WHEN NOT reverse THEN {site(motif)} END AS site, pos, reverse FROM placed)",
    ]


@query("r05_planted_sites", over_seqs("SELECT seq_id, site, pos, reverse FROM planted", *planted_sql(MOTIFS[2], 0.5, 9)))
def r05(spark, sf_dir):
    return sampling.planted(sequences(spark, sf_dir).select("seq_id", "seq"), MOTIFS[2], 0.5, 9).select("seq_id", "site", "pos", "reverse")


_SHUFFLE = "md5('4:' || motif || ':' || col)"


@query("r06_shuffled_columns", f"WITH {motif_values('lib', LIBRARY)} SELECT motif, CAST(row_number() OVER (PARTITION BY motif ORDER BY {_SHUFFLE}) - 1 AS INTEGER) AS col, a, c, g, t FROM lib")
def r06(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("motif").orderBy(F.md5(F.concat(F.lit("4:"), "motif", F.lit(":"), F.col("col").cast("string"))))) - 1
    return motif_frame(spark, LIBRARY).select("motif", place.cast("int").alias("col"), "a", "c", "g", "t")


_STRINGS = ", ".join(f"({i}, '{m.name}', '{m.best()}', '{m.reverse_complement().best()}')" for i, m in enumerate(LIBRARY))


@query(
    "j10_consensus_alignment",
    f"""WITH s AS (SELECT * FROM (VALUES {_STRINGS}) t(k, motif, best, back)),
p AS (SELECT x.motif AS m1, y.motif AS m2, x.best AS a, strand, CASE strand WHEN '+' THEN y.best ELSE {rc('y.best')} END AS b FROM s x JOIN s y ON x.k < y.k, (SELECT unnest(['+', '-']) AS strand)),
shifts AS (SELECT *, unnest(range(1 - length(b), length(a))) AS shift FROM p),
cells AS (SELECT m1, m2, strand, shift, a, b, unnest(range(greatest(0, shift), least(length(a), shift + length(b)))) AS k FROM shifts),
scores AS (SELECT m1, m2, strand, shift, sum(CASE WHEN substr(a, k + 1, 1) = substr(b, k - shift + 1, 1) THEN 1 ELSE -1 END) AS score FROM cells GROUP BY ALL)
SELECT m1, m2, CAST(shift AS INTEGER) AS shift, strand, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY m1, m2 ORDER BY score DESC, abs(shift), strand DESC, shift DESC) AS r FROM scores) WHERE r = 1""",
)
def j10(spark, sf_dir):
    """Best shift of each pair of consensus strings by matches less mismatches, on either strand."""
    flip = str.maketrans("ACGT", "TGCA")
    rows = []
    for i, m in enumerate(LIBRARY):
        for o in LIBRARY[i + 1 :]:
            a, found = m.best(), []
            for strand, b in (("+", o.best()), ("-", o.best().translate(flip)[::-1])):
                for shift in range(1 - len(b), len(a)):
                    part = [(a[k], b[k - shift]) for k in range(max(0, shift), min(len(a), shift + len(b)))]
                    found.append((sum(1 if x == y else -1 for x, y in part), -abs(shift), strand, shift))
            score, _, strand, shift = max(found)
            rows.append((m.name, o.name, shift, strand, score))
    return spark.createDataFrame(rows, "m1 string, m2 string, shift int, strand string, score int")


@query("t09_motifs_by_score", over_seqs("SELECT motif, round(total, 4) AS total, row_number() OVER (ORDER BY round(total, 4) DESC, motif) AS place FROM (SELECT motif, sum(score) AS total FROM best GROUP BY motif)", *BEST))
def t09(spark, sf_dir):
    from pyspark.sql import Window

    rows = best(spark, sf_dir).groupBy("motif").agg(F.round(F.sum("score"), 4).alias("total"))  # a row for each motif
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "motif")).cast("long"))


@query(
    "w07_inverse_sampling",
    """WITH kinds AS (SELECT event_type AS kind, count(*) AS w FROM events GROUP BY 1), upto AS (SELECT kind, sum(w) OVER (ORDER BY kind) - w AS low, sum(w) OVER (ORDER BY kind) AS high, sum(w) OVER () AS total FROM kinds)
SELECT kind, count(*) AS n FROM (SELECT CAST(('0x' || substr(md5('2:' || event_id), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM events) JOIN upto ON u * total >= low AND u * total < high GROUP BY kind""",
)
def w07(spark, sf_dir):
    """Events dealt to kinds by inverting the cumulative distribution of the kinds that they have."""
    events = table(spark, sf_dir, "events")
    kinds = events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("w"))
    dealt = sampling.inverse(events.select("event_id"), sampling.uniform(2, "event_id"), kinds, "kind", "w")
    return dealt.groupBy("kind").agg(F.count("*").alias("n"))
