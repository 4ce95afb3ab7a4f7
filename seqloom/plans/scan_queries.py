"""Queries of scans with weight matrices, rankings, histograms and position lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dna, ordered, stats
from ..operators import kmers, metrics, positions, scan
from ..operators.motifs import Motif
from ..sources.corpus import letters, sequences, table
from .registry import over_seqs, query, rc, recursive, windows
from .scratch import kept

#: Small motifs that the queries scan with.
MOTIFS = [Motif.of_consensus("m1", "TAATTA"), Motif.of_consensus("m2", "GATNATC"), Motif.of_consensus("m3", "ANRTTAAY")]
THRESHOLD = -6.0


def motif_rows() -> str:
    """SQL values (motif, width, col, base, f, r): log weights of a base at a column on either strand."""
    rows = []
    for m in MOTIFS:
        back = m.reverse_complement()
        rows += [f"('{m.name}', {len(m)}, {c}, '{b}', {float(m.logs[c, k])!r}::DOUBLE, {float(back.logs[c, k])!r}::DOUBLE)" for c in range(len(m)) for k, b in enumerate("ACGT")]
    return f"motifs AS (SELECT * FROM (VALUES {', '.join(rows)}) t(motif, width, col, base, f, r))"


#: Windows by distinct k-mer, so that a k-mer's columns are added up once.
SCORED = (
    motif_rows(),
    "wins AS (SELECT seq_id, len, motif, width, pos, substr(seq, pos + 1, width) AS kmer FROM (SELECT seq_id, seq, length(seq) AS len, motif, width, unnest(range(0, length(seq) - width + 1)) AS pos FROM seqs, (SELECT DISTINCT motif, width FROM motifs)))",
    "kscores AS (SELECT k.motif, kmer, round(sum(f), 9) AS a, round(sum(r), 9) AS b FROM (SELECT DISTINCT motif, kmer FROM wins) k JOIN motifs m ON m.motif = k.motif AND m.base = substr(kmer, col + 1, 1) GROUP BY ALL)",
    "scored AS (SELECT seq_id, motif, width, len, pos, a, b, greatest(a, b) AS score, b > a AS reverse FROM wins JOIN kscores USING (motif, kmer))",
)
HITS = (*SCORED, f"hits AS (SELECT s.seq_id, motif, width, pos, score, reverse, len AS seq_len, q.weight FROM scored s JOIN seqs q USING (seq_id) WHERE score >= {THRESHOLD})")
BEST = (*SCORED, "best AS (SELECT seq_id, motif, width, pos, score, reverse FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, motif ORDER BY score DESC, pos, reverse) AS k FROM scored) WHERE k = 1)")


def hits(spark, sf_dir, *names):
    """Hits of all motifs, or of those with the names."""
    return scan.scan(sequences(spark, sf_dir), [m for m in MOTIFS if not names or m.name in names], THRESHOLD)


def located(spark, sf_dir):
    """hits with the motif's width and the sequence's length and weight."""
    return scan.scan(sequences(spark, sf_dir), MOTIFS, THRESHOLD, located=True)


def best(spark, sf_dir, *names, located=False):
    """The best window of each sequence and motif."""
    return scan.scan(sequences(spark, sf_dir), [m for m in MOTIFS if not names or m.name in names], None, best_only=True, located=located)


def labelled(spark, sf_dir, *names):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("label"))
    return best(spark, sf_dir, *names).join(labels, "seq_id")


LABELLED = (*BEST, "labelled AS (SELECT b.*, l.quality AS label FROM best b JOIN labels l ON l.doc_id = b.seq_id)")


@query("a01_scan", over_seqs("SELECT seq_id, motif, CAST(pos AS INTEGER) AS pos, reverse, round(score, 6) AS score FROM hits", *HITS))
def a01(spark, sf_dir):
    return hits(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("f01_above_threshold", over_seqs("SELECT motif, count(*) AS n_at_least, count(*) FILTER (score > -4.0) AS n_above FROM hits GROUP BY motif", *HITS))
def f01(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("motif").agg(F.count("*").alias("n_at_least"), F.count_if(F.col("score") > -4.0).alias("n_above"))


@query("a02_best_hit", over_seqs("SELECT seq_id, motif, CAST(pos AS INTEGER) AS pos, reverse, round(score, 6) AS score FROM best", *BEST))
def a02(spark, sf_dir):
    return best(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("a03_max_score", over_seqs("SELECT seq_id, motif, round(max(score), 6) AS score FROM scored GROUP BY ALL", *SCORED))
def a03(spark, sf_dir):
    return best(spark, sf_dir).select("seq_id", "motif", F.round("score", 6).alias("score"))


@query("k08_score_matrix", over_seqs("SELECT seq_id, " + ", ".join(f"round(max(score) FILTER (motif = '{m.name}'), 6) AS {m.name}" for m in MOTIFS) + " FROM scored GROUP BY seq_id", *SCORED))
def k08(spark, sf_dir):
    wide = best(spark, sf_dir).groupBy("seq_id").pivot("motif", [m.name for m in MOTIFS]).agg(F.max("score"))
    return wide.select("seq_id", *(F.round(m.name, 6).alias(m.name) for m in MOTIFS))


@query("t01_hits_by_score", over_seqs("SELECT seq_id, motif, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, seq_id, motif, hits.pos LIMIT 100", *HITS))
def t01(spark, sf_dir):
    rows = hits(spark, sf_dir).orderBy(F.desc("score"), "seq_id", "motif", "pos").limit(100)
    return rows.select("seq_id", "motif", "pos", F.round("score", 6).alias("score"))


@query("j13_strand_union", over_seqs("SELECT motif, reverse, count(*) AS n, count(DISTINCT seq_id) AS n_seqs FROM hits GROUP BY motif, reverse", *HITS))
def j13(spark, sf_dir):
    found = kept(hits(spark, sf_dir))
    both = found.where(~F.col("reverse")).unionByName(found.where("reverse"))
    return both.groupBy("motif", "reverse").agg(F.count("*").alias("n"), F.countDistinct("seq_id").alias("n_seqs"))


_MIDDLE = "((pos + width // 2) % seq_len)"


@query(
    "a15_position_histogram",
    over_seqs(f"SELECT motif, bin, round(n, 6) AS n, round(n / sum(n) OVER (PARTITION BY motif), 6) AS p FROM (SELECT motif, CAST(floor(10 * {_MIDDLE} / seq_len) AS INTEGER) AS bin, sum(exp(score)) AS n FROM hits GROUP BY 1, 2)", *HITS),
)
def a15(spark, sf_dir):
    found = metrics.position_histogram(located(spark, sf_dir), 10, F.exp("score"))
    return found.select("motif", "bin", F.round("n", 6).alias("n"), F.round("p", 6).alias("p"))


@query(
    "a15_rank_histogram",
    over_seqs("SELECT motif, CAST(floor(10 * r / total) AS INTEGER) AS bin, count(*) AS n FROM best JOIN (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS r, count(*) OVER () AS total FROM seqs) USING (seq_id) WHERE score >= -5 GROUP BY 1, 2", *BEST),
)
def a15_rank(spark, sf_dir):
    return ranked_bins(spark, sf_dir).groupBy("motif", "bin").agg(F.count("*").alias("n"))


def ranked_bins(spark, sf_dir):
    """Best hits with the bin of their sequence's rank."""
    ids = ordered.numbered(sequences(spark, sf_dir).select("seq_id"), "seq_id")
    total = ids.agg(F.count("*").alias("total"))
    bins = ids.crossJoin(F.broadcast(total)).select("seq_id", F.floor(10 * F.col("rank") / F.col("total")).cast("int").alias("bin"))
    return best(spark, sf_dir).where("score >= -5").join(bins, "seq_id")


@query("w10_rank_bins", over_seqs("SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS rank, CAST(floor(20 * (row_number() OVER (ORDER BY seq_id) - 1) / count(*) OVER ()) AS INTEGER) AS bin FROM seqs"))
def w10(spark, sf_dir):
    ids = ordered.numbered(sequences(spark, sf_dir).select("seq_id"), "seq_id")
    return ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("total")))).select("seq_id", "rank", F.floor(20 * F.col("rank") / F.col("total")).cast("int").alias("bin"))


@query(
    "a16_position_chi_square",
    over_seqs(f"SELECT motif, round(sum(n * n) / (sum(n) / 8.0) - sum(n), 6) AS chi2, 8 AS bins_used FROM (SELECT motif, floor(10 * {_MIDDLE} / seq_len) AS bin, CAST(count(*) AS DOUBLE) AS n FROM hits GROUP BY 1, 2) WHERE bin >= 1 AND bin < 9 GROUP BY motif", *HITS),
)
def a16(spark, sf_dir):
    found = metrics.chi_square(metrics.position_histogram(located(spark, sf_dir), 10), 10, 1, 9)
    return found.select("motif", F.round("chi2", 6).alias("chi2"), "bins_used")


@query("f07_bias_significance")
def f07(spark, sf_dir):
    """Whether position, rank and strand are biased: chi-square tails of few numbers, on the driver."""
    found = kept(located(spark, sf_dir).drop("weight"))
    place = {r["motif"]: r["chi2"] for r in metrics.chi_square(metrics.position_histogram(found, 10), 10, 1, 9).collect()}
    counts = ranked_bins(spark, sf_dir).groupBy("motif", "bin").agg(F.count("*").cast("double").alias("n"))
    rank = {r["motif"]: r["chi2"] for r in metrics.chi_square(counts, 10, 0, 9).collect()}
    strand = {r["motif"]: (r["n"], r["back"]) for r in found.groupBy("motif").agg(F.count("*").alias("n"), F.count_if("reverse").alias("back")).collect()}
    rows = []
    for m in MOTIFS:
        n, back = strand.get(m.name, (0, 0))
        tail = 2 * min(stats.binomial_tail(back, n, 0.5), 1 - stats.binomial_tail(back + 1, n, 0.5))
        rows.append((m.name, stats.chi_square_tail(place.get(m.name, 0.0), 7), stats.chi_square_tail(rank.get(m.name, 0.0), 8), min(1.0, tail)))
    return spark.createDataFrame(rows, "motif string, p_position double, p_rank double, p_strand double")


_CORR = "round(corr({0}, {1}), 6)"


@query("a17_pearson", over_seqs(f"SELECT motif, {_CORR.format('score', 'weight')} AS pearson FROM best JOIN seqs USING (seq_id) GROUP BY motif", *BEST))
def a17(spark, sf_dir):
    rows = best(spark, sf_dir, located=True)
    return rows.groupBy("motif").agg(F.round(F.corr("score", "weight"), 6).alias("pearson"))


_AVG_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query(
    "a18_spearman",
    over_seqs(f"SELECT 'm1' AS motif, {_CORR.format('x', 'y')} AS spearman FROM (SELECT {_AVG_RANK.format('score')} AS x, {_AVG_RANK.format('weight')} AS y FROM best JOIN seqs USING (seq_id) WHERE motif = 'm1')", *BEST),
)
def a18(spark, sf_dir):
    rows = kept(best(spark, sf_dir, "m1", located=True).select("score", "weight"))
    return metrics.spearman(rows, "score", "weight").select(F.lit("m1").alias("motif"), F.round("spearman", 6).alias("spearman"))


@query(
    "a19_intensity_correlation",
    over_seqs(f"SELECT motif, {_CORR.format('exp(score)', 'weight')} AS pearson, count(*) AS n FROM best JOIN (SELECT seq_id, weight, row_number() OVER (ORDER BY weight DESC, seq_id) AS r, count(*) OVER () AS total FROM seqs) USING (seq_id) WHERE r <= 0.2 * total GROUP BY motif", *BEST),
)
def a19(spark, sf_dir):
    """Correlation of exp(score) and intensity over the strongest fifth of the sequences."""
    seqs = sequences(spark, sf_dir).select("seq_id", "weight")
    keyed = seqs.withColumn("falling", F.row_number().over(Window.partitionBy("weight").orderBy("seq_id")) - 1)
    at = ordered.running_sums(seqs.groupBy((-F.col("weight")).alias("w")).agg(F.count("*").alias("n")), "w", ["n"]).select((-F.col("w")).alias("weight"), "before_n")
    total = seqs.agg(F.count("*").alias("total"))
    top = keyed.join(at, "weight").crossJoin(F.broadcast(total)).where(F.col("before_n") + F.col("falling") + 1 <= 0.2 * F.col("total")).select("seq_id", "weight")
    rows = best(spark, sf_dir).join(top, "seq_id")
    return rows.groupBy("motif").agg(F.round(F.corr(F.exp("score"), "weight"), 6).alias("pearson"), F.count("*").alias("n"))


@query("a20_mean_log_likelihood", over_seqs("SELECT motif, round(avg(score - width * ln(0.25)), 6) AS mean_llr FROM best GROUP BY motif", *BEST))
def a20(spark, sf_dir):
    width = F.create_map(*(x for m in MOTIFS for x in (F.lit(m.name), F.lit(len(m)))))[F.col("motif")]
    return best(spark, sf_dir).groupBy("motif").agg(F.round(F.avg(F.col("score") - width * F.log(F.lit(0.25))), 6).alias("mean_llr"))


_AUC = "(sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label))"


@query(
    "a21_auc",
    over_seqs(f"SELECT motif, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round({_AUC}, 6) AS auc FROM (SELECT motif, label, rank() OVER (PARTITION BY motif ORDER BY score) + (count(*) OVER (PARTITION BY motif, score) - 1) / 2.0 AS r FROM labelled) GROUP BY motif", *LABELLED),
)
def a21(spark, sf_dir):
    return metrics.auc(kept(labelled(spark, sf_dir).select("motif", "score", "label")), "motif").withColumn("auc", F.round("auc", 6))


@query(
    "a21_roc",
    over_seqs("SELECT round(score, 6) AS score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM labelled WHERE motif = 'm1' GROUP BY score) WINDOW w AS (ORDER BY score DESC)", *LABELLED),
)
def a21_roc(spark, sf_dir):
    rows = metrics.roc(kept(labelled(spark, sf_dir, "m1").select("score", "label")))
    return rows.select(F.round("score", 6).alias("score"), "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(
    "a22_signal_auc",
    f"SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round({_AUC}, 6) AS auc FROM (SELECT quality AS label, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id))",
)
def a22(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    return metrics.auc(rows).withColumn("auc", F.round("auc", 6))


@query(
    "a23_hit_rate_z",
    over_seqs("SELECT motif, n_pos, n_neg, hit_pos, hit_neg, round((hit_pos - n_pos * p) / sqrt(n_pos * p * (1 - p)), 6) AS z FROM (SELECT *, (hit_neg + 1) / (n_neg + 2) AS p FROM (SELECT motif, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1 AND score >= -5) AS hit_pos, count(*) FILTER (label = 0 AND score >= -5) AS hit_neg FROM labelled GROUP BY motif))", *LABELLED),
)
def a23(spark, sf_dir):
    rows = metrics.enrichment(labelled(spark, sf_dir).select("motif", "label", (F.col("score") >= -5).alias("hit")))
    return rows.withColumn("z", F.round("z", 6))


@query(
    "a24_confusion",
    over_seqs(
        "SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round(tp / nullif(tp + fn, 0), 6) AS sn, round(tn / nullif(tn + fp, 0), 6) AS spc, round(tp / nullif(tp + fp, 0), 6) AS ppv, round((tp / nullif(tp + fn, 0) + tp / nullif(tp + fp, 0)) / 2, 6) AS asp, round((tp * tn - fn * fp) / nullif(sqrt((tp + fn) * (tn + fp) * (tp + fp) * (tn + fn)), 0), 6) AS cc FROM (SELECT CAST(count(*) FILTER (label = 1 AND score >= -5) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 0 AND score >= -5) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 0 AND score < -5) AS DOUBLE) AS tn, CAST(count(*) FILTER (label = 1 AND score < -5) AS DOUBLE) AS fn FROM labelled WHERE motif = 'm2')",
        *LABELLED,
    ),
)
def a24(spark, sf_dir):
    row = metrics.confusion(labelled(spark, sf_dir, "m2").select("score", "label"), -5.0)
    return row.select("tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("sn", "spc", "ppv", "asp", "cc")))


LOG_CHOOSE = "(lgamma(({n}) + 1.0) - lgamma(({k}) + 1.0) - lgamma(({n}) - ({k}) + 1.0))"


def log_choose(n: str, k: str) -> str:
    return LOG_CHOOSE.format(n=n, k=k)


@query(
    "a24_hypergeometric",
    over_seqs(
        f"SELECT 'm2' AS motif, round(1 - least(1.0, coalesce(sum(exp({log_choose('good', 'i')} + {log_choose('total - good', 'drawn - i')} - {log_choose('total', 'drawn')})), 0.0)), 6) AS p FROM (SELECT *, unnest(range(greatest(0, drawn - (total - good)), tp)) AS i FROM calls)",
        *LABELLED,
        "calls AS (SELECT count(*) AS total, count(*) FILTER (label = 1) AS good, count(*) FILTER (score >= -5) AS drawn, count(*) FILTER (label = 1 AND score >= -5) AS tp FROM labelled WHERE motif = 'm2')",
    ),
)
def a24_hypergeometric(spark, sf_dir):
    row = metrics.confusion(labelled(spark, sf_dir, "m2").select("score", "label"), -5.0).first()
    return spark.createDataFrame([("m2", round(metrics.hypergeometric(row), 6))], "motif string, p double")


_ORDERED_HITS = "(SELECT motif, seq_id, pos, score, lag(pos) OVER (PARTITION BY motif, seq_id ORDER BY pos) AS last FROM hits)"


@query("w01_spaced_hits", over_seqs(f"SELECT motif, seq_id, CAST(pos AS INTEGER) AS pos FROM {_ORDERED_HITS} WHERE last IS NULL OR last < pos - 5", *HITS))
def w01(spark, sf_dir):
    return positions.spaced(hits(spark, sf_dir), ["motif", "seq_id"], "pos", 5).select("motif", "seq_id", "pos")


_ISLANDS = f"(SELECT *, sum(CASE WHEN last IS NULL OR pos - last > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY motif, seq_id ORDER BY pos) AS island FROM {_ORDERED_HITS})"


@query("w03_overlap_competition", over_seqs(f"SELECT motif, seq_id, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY motif, seq_id, island ORDER BY score DESC, pos) AS k FROM {_ISLANDS}) WHERE k = 1", *HITS))
def w03(spark, sf_dir):
    return positions.best_of_islands(hits(spark, sf_dir), ["motif", "seq_id"], "pos", "score", 8).select("motif", "seq_id", "pos", F.round("score", 6).alias("score"))


@query(
    "w03_withdrawn_competition",
    recursive(
        over_seqs(
            "SELECT motif, seq_id, n, round(t, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY motif, seq_id ORDER BY k DESC) AS r FROM walked) WHERE r = 1",
            *HITS,
            "placed AS (SELECT motif, seq_id, pos, score, row_number() OVER (PARTITION BY motif, seq_id ORDER BY pos) AS k FROM hits)",
            """walked AS (SELECT motif, seq_id, k, pos, score, 1::BIGINT AS n, exp(score) AS t FROM placed WHERE k = 1 UNION ALL
SELECT w.motif, w.seq_id, p.k, CASE WHEN p.pos - w.pos > 8 OR p.score > w.score THEN p.pos ELSE w.pos END, CASE WHEN p.pos - w.pos > 8 OR p.score > w.score THEN p.score ELSE w.score END, w.n + CASE WHEN p.pos - w.pos > 8 THEN 1 ELSE 0 END,
  CASE WHEN p.pos - w.pos > 8 THEN w.t + exp(p.score) WHEN p.score > w.score THEN w.t - 0.8 * exp(w.score) + exp(p.score) ELSE w.t END FROM walked w JOIN placed p ON p.motif = w.motif AND p.seq_id = w.seq_id AND p.k = w.k + 1)""",
        )
    ),
)
def w03_withdrawn(spark, sf_dir):
    return positions.competition(hits(spark, sf_dir), ["motif", "seq_id"], "pos", "score", 8).withColumn("total", F.round("total", 6))


@query("w04_per_sequence_state", over_seqs("SELECT motif, seq_id, CAST(pos AS INTEGER) AS pos, row_number() OVER (PARTITION BY motif, seq_id ORDER BY pos) AS k, round(sum(exp(score)) OVER (PARTITION BY motif, seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 6) AS mass FROM hits", *HITS))
def w04(spark, sf_dir):
    w = Window.partitionBy("motif", "seq_id").orderBy("pos")
    return hits(spark, sf_dir).select("motif", "seq_id", "pos", F.row_number().over(w).cast("long").alias("k"), F.round(F.sum(F.exp("score")).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("mass"))


@query("w05_sliding_max", over_seqs("SELECT motif, seq_id, CAST(pos AS INTEGER) AS pos, round(max(score) OVER (PARTITION BY motif, seq_id ORDER BY pos RANGE BETWEEN 20 PRECEDING AND 19 FOLLOWING), 6) AS top FROM hits", *HITS))
def w05(spark, sf_dir):
    found = hits(spark, sf_dir)
    return found.select("motif", "seq_id", "pos", F.round(positions.sliding_max(found, ["motif", "seq_id"], "pos", "score", 20), 6).alias("top"))


@query(
    "w06_shifted_profile_sum",
    over_seqs("SELECT a.seq_id, CAST(a.pos AS INTEGER) AS pos, round(a.score + b.score, 6) AS score FROM scored a JOIN scored b ON a.seq_id = b.seq_id AND b.pos = a.pos + 9 WHERE a.motif = 'm1' AND b.motif = 'm2' AND round(a.score + b.score, 9) >= -12", *SCORED),
)
def w06(spark, sf_dir):
    """Two motifs, the second 9 behind the first: the sum of their profiles, where it reaches -12."""
    at = lambda m, shift, name: scan.scan(sequences(spark, sf_dir), [m], -12.0).select("seq_id", (F.col("pos") - shift).alias("pos"), F.col("score").alias(name))
    rows = at(MOTIFS[0], 0, "a").join(at(MOTIFS[1], 9, "b"), ["seq_id", "pos"])
    return rows.where(F.round(F.col("a") + F.col("b"), 9) >= -12).select("seq_id", "pos", F.round(F.col("a") + F.col("b"), 6).alias("score"))


@query("w08_merged_sites", over_seqs(f"SELECT motif, seq_id, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, count(*) AS n FROM {_ISLANDS} GROUP BY motif, seq_id, island HAVING count(*) >= 2", *HITS))
def w08(spark, sf_dir):
    return positions.merged(hits(spark, sf_dir), ["motif", "seq_id"], "pos", 8)


@query("w09_one_hit_a_bin", over_seqs("SELECT motif, seq_id, CAST(pos AS INTEGER) AS pos FROM (SELECT *, lag(pos // 50) OVER (PARTITION BY motif, seq_id ORDER BY pos) AS b FROM hits) WHERE b IS NULL OR b <> pos // 50", *HITS))
def w09(spark, sf_dir):
    cell = F.floor(F.col("pos") / 50)
    rows = hits(spark, sf_dir).withColumn("b", F.lag(cell).over(Window.partitionBy("motif", "seq_id").orderBy("pos")))
    return rows.where(F.col("b").isNull() | (F.col("b") != cell)).select("motif", "seq_id", "pos")


@query("j07_range_proximity", over_seqs("SELECT a.seq_id, CAST(a.pos AS INTEGER) AS a, CAST(b.pos AS INTEGER) AS b FROM hits a JOIN hits b ON a.seq_id = b.seq_id AND abs(a.pos - b.pos) <= 5 WHERE a.motif = 'm1' AND b.motif = 'm2'", *HITS))
def j07(spark, sf_dir):
    found = kept(hits(spark, sf_dir, "m1", "m2"))
    return positions.near(found.where("motif = 'm1'"), found.where("motif = 'm2'"), "seq_id", "pos", 5)


def greedy_sql(lists: str) -> str:
    """Common tables that walk two sorted lists (key, x, y) of each key: pairs(key, a, b)."""
    ended = "(i > len(x) OR j > len(y))"
    return f"""walk AS (SELECT key, x, y, 1 AS i, 1 AS j, NULL::BIGINT AS a, NULL::BIGINT AS b FROM ({lists})
UNION ALL SELECT key, x, y, i + CASE WHEN abs(x[i] - y[j]) <= 5 OR x[i] < y[j] THEN 1 ELSE 0 END, j + CASE WHEN abs(x[i] - y[j]) <= 5 OR x[i] >= y[j] THEN 1 ELSE 0 END,
  CASE WHEN abs(x[i] - y[j]) <= 5 THEN x[i] END, CASE WHEN abs(x[i] - y[j]) <= 5 THEN y[j] END FROM walk WHERE NOT {ended}),
pairs AS (SELECT key, a, b FROM walk WHERE a IS NOT NULL)"""


@query(
    "j06_greedy_proximity",
    recursive(over_seqs("SELECT key AS seq_id, a, b FROM pairs", *HITS, greedy_sql("SELECT seq_id AS key, list(pos ORDER BY pos) FILTER (motif = 'm1') AS x, list(pos ORDER BY pos) FILTER (motif = 'm2') AS y FROM hits GROUP BY seq_id HAVING x IS NOT NULL AND y IS NOT NULL"))),
)
def j06(spark, sf_dir):
    found = kept(hits(spark, sf_dir, "m1", "m2"))
    return positions.greedy(found.where("motif = 'm1'"), found.where("motif = 'm2'"), "seq_id", "pos", 5)


#: Spaced hits, greedy pairs of any two motifs in a sequence, and their share: overlap(m1, m2, n_near, ratio).
OVERLAP = (
    *HITS,
    f"spaced AS (SELECT motif, seq_id, pos FROM {_ORDERED_HITS} WHERE last IS NULL OR last < pos - 5)",
    "plists AS (SELECT motif, seq_id, list(pos ORDER BY pos) AS p FROM spaced GROUP BY ALL)",
    greedy_sql("SELECT (x.motif, y.motif, x.seq_id) AS key, x.p AS x, y.p AS y FROM plists x JOIN plists y ON x.seq_id = y.seq_id AND x.motif < y.motif"),
    "sizes AS (SELECT motif, count(*) AS n FROM spaced GROUP BY motif)",
    "overlap AS (SELECT x.motif AS m1, y.motif AS m2, coalesce(k, 0) AS n_near, coalesce(k, 0) / (least(x.n, y.n) + 1) AS ratio FROM sizes x JOIN sizes y ON x.motif < y.motif LEFT JOIN (SELECT key[1] AS m1, key[2] AS m2, count(*) AS k FROM pairs GROUP BY 1, 2) c ON c.m1 = x.motif AND c.m2 = y.motif)",
)


@query("a25_overlap_ratio", recursive(over_seqs("SELECT m1, m2, n_near, ratio FROM overlap", *OVERLAP)))
def a25(spark, sf_dir):
    return positions.overlap_ratio(kept(positions.spaced(hits(spark, sf_dir), ["motif", "seq_id"], "pos", 5).select("motif", "seq_id", "pos")), 5)


@query("j14_prior_lookup", over_seqs("SELECT motif, seq_id, CAST(pos AS INTEGER) AS pos, round(score + ln(0.05 * (1 + (pos * 20 // seq_len) % 2)), 6) AS score FROM hits", *HITS))
def j14(spark, sf_dir):
    """Hits with the log prior of their position's bin added: a join with a table of 20 rows."""
    prior = spark.range(20).select(F.col("id").alias("bin"), F.log(0.05 * (1 + F.col("id") % 2)).alias("logp"))
    rows = located(spark, sf_dir).withColumn("bin", F.floor(F.col("pos") * 20 / F.col("seq_len")))
    return rows.join(F.broadcast(prior), "bin", "left").select("motif", "seq_id", "pos", F.round(F.col("score") + F.coalesce("logp", F.lit(0.0)), 6).alias("score"))


@query("a34_kolmogorov", over_seqs("SELECT motif, CAST(max(t) AS BIGINT) AS n, round(max(greatest(abs(hi - v), abs(lo - v))), 6) AS ks FROM (SELECT motif, v, sum(c) OVER w / sum(c) OVER (PARTITION BY motif) AS hi, (sum(c) OVER w - c) / sum(c) OVER (PARTITION BY motif) AS lo, sum(c) OVER (PARTITION BY motif) AS t FROM (SELECT motif, pos / seq_len AS v, count(*) AS c FROM hits GROUP BY ALL) WINDOW w AS (PARTITION BY motif ORDER BY v)) GROUP BY motif", *HITS))
def a34(spark, sf_dir):
    rows = kept(located(spark, sf_dir).select("motif", (F.col("pos") / F.col("seq_len")).alias("v")))
    return metrics.kolmogorov(rows, "v", "motif").select("motif", "n", F.round("ks", 6).alias("ks"))


_ENRICH = "SELECT motif, bin, CAST(n AS BIGINT) AS n, round((s - t * (bin + 1) / 10.0) / sqrt(t * (bin + 1) / 10.0 * (1 - (bin + 1) / 10.0)), 6) AS z FROM (SELECT *, sum(n) OVER (PARTITION BY motif ORDER BY bin) AS s, sum(n) OVER (PARTITION BY motif) AS t FROM (SELECT motif, least(CAST(floor(abs(pos + width / 2 - seq_len / 2) / (seq_len / 2) * 10) AS INTEGER), 9) AS bin, count(*) AS n FROM hits GROUP BY 1, 2)) WHERE bin < 9"


@query("a28_centre_enrichment", over_seqs(_ENRICH, *HITS))
def a28(spark, sf_dir):
    """Distance bins from the sequence centre, and the z-score of all hits up to each bin against an even spread."""
    away = F.abs(F.col("pos") + F.col("width") / 2 - F.col("seq_len") / 2) / (F.col("seq_len") / 2)
    bins = located(spark, sf_dir).groupBy("motif", F.least(F.floor(away * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("motif")
    share = (F.col("bin") + 1) / F.lit(10.0)
    rows = bins.withColumn("s", F.sum("n").over(w.orderBy("bin"))).withColumn("t", F.sum("n").over(w)).where("bin < 9")
    return rows.select("motif", "bin", "n", F.round((F.col("s") - F.col("t") * share) / F.sqrt(F.col("t") * share * (1 - share)), 6).alias("z"))


_AWAY = "abs(pos + width / 2 - seq_len / 2) / (seq_len / 2)"


@query(
    "a28_geometric_windows",
    over_seqs(
        "SELECT motif, CAST(k AS INTEGER) AS k, n_inside, round((s / nullif(t - s, 0)) / (r / (1 - r)), 6) AS odds, round((s - t * r) / sqrt(t * r * (1 - r)), 6) AS z FROM (SELECT motif, k, 0.05 * pow(1.1, k) AS r, n_inside, CAST(n_inside AS DOUBLE) AS s, CAST(t AS DOUBLE) AS t FROM inside)",
        *HITS,
        f"binned AS (SELECT motif, CASE WHEN {_AWAY} <= 0.05 THEN 0 ELSE least(ceil(ln({_AWAY} / 0.05) / ln(1.1) - 1e-9), 32) END AS b FROM hits)",
        "inside AS (SELECT m.motif, k, t, (SELECT count(*) FROM binned x WHERE x.motif = m.motif AND x.b <= k) AS n_inside FROM (SELECT motif, count(*) AS t FROM binned GROUP BY motif) m, (SELECT unnest(range(0, 32)) AS k))",
    ),
)
def a28_geometric(spark, sf_dir):
    away = F.abs(F.col("pos") + F.col("width") / 2 - F.col("seq_len") / 2) / (F.col("seq_len") / 2)
    rows = metrics.geometric_windows(located(spark, sf_dir).select("motif", away.alias("away")))
    return rows.select("motif", "k", "n_inside", F.round("odds", 6).alias("odds"), F.round("z", 6).alias("z"))


@query(
    "a30_centre_binomial",
    over_seqs(
        f"SELECT motif, inside, n, round((SELECT sum(exp({log_choose('n', 'k')} + n * ln(0.5))) FROM (SELECT unnest(range(inside, n + 1)) AS k)), 9) AS p FROM (SELECT motif, count(*) FILTER (abs(pos + width / 2 - seq_len / 2) < seq_len / 4) AS inside, count(*) AS n FROM hits GROUP BY motif)",
        *HITS,
    ),
)
def a30(spark, sf_dir):
    """Binomial p-value of the share of hits in the middle half of their sequences."""
    inside = F.abs(F.col("pos") + F.col("width") / 2 - F.col("seq_len") / 2) < F.col("seq_len") / 4
    rows = located(spark, sf_dir).groupBy("motif").agg(F.count_if(inside).alias("inside"), F.count("*").alias("n")).collect()
    return spark.createDataFrame([(r["motif"], r["inside"], r["n"], round(stats.binomial_tail(r["inside"], r["n"], 0.5), 9)) for r in rows], "motif string, inside long, n long, p double")


@query("a31_decay_fit")
def a31(spark, sf_dir):
    """An exponential decay fitted to the distances of hits from the sequence centre."""
    away = F.abs(F.col("pos") + F.col("width") / 2 - F.col("seq_len") / 2) / (F.col("seq_len") / 2)
    rows = located(spark, sf_dir).groupBy("motif", F.least(F.floor(away * 50), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    out = []
    for m in MOTIFS:
        own = [(r["bin"], r["n"]) for r in rows if r["motif"] == m.name]
        if len(own) > 3:
            out.append((m.name, *stats.fit_decay([b for b, _ in own], [n for _, n in own])))
    return spark.createDataFrame(out, "motif string, a double, b double, c double")


@query("t06_quantile_threshold", over_seqs("SELECT motif, round(min(score), 6) AS threshold FROM (SELECT motif, score, row_number() OVER (PARTITION BY motif ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY motif) AS n FROM best) WHERE k <= greatest(1, ceil(n * 0.05)) GROUP BY motif", *BEST))
def t06(spark, sf_dir):
    """The score that a twentieth of the sequences reach with their best hits."""
    rows = kept(best(spark, sf_dir).groupBy("motif", "score").agg(F.count("*").alias("n")))
    total = rows.groupBy("motif").agg(F.sum("n").alias("total"))
    ranked = ordered.running_sums(rows.withColumn("falling", -F.col("score")), "falling", ["n"], by="motif").join(F.broadcast(total), "motif")
    reached = ranked.where(F.col("before_n") < F.greatest(F.lit(1), F.ceil(F.col("total") * 0.05)))
    return reached.groupBy("motif").agg(F.round(F.min("score"), 6).alias("threshold"))


@query("t07_false_discovery", over_seqs("SELECT motif, round(avg(CASE WHEN score > -5 THEN 1.0 ELSE 0.0 END), 6) AS fdr FROM labelled WHERE label = 0 GROUP BY motif", *LABELLED))
def t07(spark, sf_dir):
    return labelled(spark, sf_dir).where("label = 0").groupBy("motif").agg(F.round(F.avg((F.col("score") > -5).cast("double")), 6).alias("fdr"))


_U = "CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 12)) AS BIGINT) / 281474976710656.0"


@query("r02_importance_sample", over_seqs("SELECT seq_id, CAST(pos AS INTEGER) AS pos FROM scored WHERE motif = 'm1' AND " + _U.format(seed=7, key="seq_id || ':' || pos") + " < least(1.0, exp(score + 6 * ln(4.0)) * 0.01)", *SCORED))
def r02(spark, sf_dir):
    """Windows drawn with a probability that grows with their likelihood; the draw is a hash of their place."""
    from ..operators.sampling import uniform

    rows = scan.scan(sequences(spark, sf_dir), MOTIFS[:1], None)
    keep = uniform(7, F.concat_ws(":", "seq_id", "pos")) < F.least(F.lit(1.0), F.exp(F.col("score") + 6 * F.log(F.lit(4.0))) * 0.01)
    return rows.where(keep).select("seq_id", "pos")


@query("j01_kmer_lookup", over_seqs("SELECT seq_id, CAST(pos AS INTEGER) AS pos, kmer FROM kmers6 WHERE kmer IN ('TTATTA', 'TAATTA', 'GATTAC', 'ACGTAC')", windows(6)))
def j01(spark, sf_dir):
    patterns = spark.createDataFrame([(k,) for k in ("TTATTA", "TAATTA", "GATTAC", "ACGTAC")], "kmer string")
    return kmers.explode(sequences(spark, sf_dir), 6).join(F.broadcast(patterns), "kmer").select("seq_id", "pos", "kmer")


@query("j02_adjacent_postings", over_seqs("SELECT a.seq_id, CAST(a.pos AS INTEGER) AS pos FROM kmers4 a JOIN kmers4 b ON a.seq_id = b.seq_id AND b.pos = a.pos + 4 WHERE a.kmer = 'TTAT' AND b.kmer = 'TAAT'", windows(4)))
def j02(spark, sf_dir):
    rows = kmers.explode(sequences(spark, sf_dir), 4).where(F.col("kmer").isin("TTAT", "TAAT"))
    return positions.adjacent(rows.where("kmer = 'TTAT'"), rows.where("kmer = 'TAAT'"), 4)


@query("j03_anchor_then_verify", over_seqs("SELECT k.seq_id, CAST(k.pos AS INTEGER) AS pos FROM kmers4 k JOIN seqs s ON k.seq_id = s.seq_id WHERE k.kmer = 'GATT' AND regexp_full_match(substr(s.seq, k.pos + 1, 10), 'GATT..[AT]A.T')", windows(4)))
def j03(spark, sf_dir):
    rows = kmers.explode(sequences(spark, sf_dir), 10)
    return rows.where(F.col("kmer").startswith("GATT") & F.col("kmer").rlike("^GATT..[AT]A.T$")).select("seq_id", "pos")


_ITEMS = "items AS (SELECT DISTINCT substr(seq, p + 1, 20) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - 19)) AS p FROM (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)))"
_SHARED = "shared AS (SELECT DISTINCT seq_id FROM kmers20 JOIN items USING (kmer))"


@query("j04_contamination", over_seqs("SELECT seq_id FROM seqs WHERE seq_id NOT IN (SELECT seq_id FROM shared)", windows(20), _ITEMS, _SHARED))
def j04(spark, sf_dir):
    """Sequences that share no 20-mer with the benchmark's: an anti join on hashes."""
    seqs = sequences(spark, sf_dir)
    return seqs.select("seq_id").join(shared(spark, sf_dir, seqs, 20), "seq_id", "left_anti")


def shared(spark, sf_dir, seqs, k):
    """(seq_id) of the sequences that share a k-mer with the benchmark's."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), letters("text").alias("seq"))
    return kmers.sharing(seqs, items, k)


@query("u03_removed_controls", over_seqs("SELECT seq_id FROM shared", windows(20), _ITEMS, _SHARED))
def u03(spark, sf_dir):
    return shared(spark, sf_dir, sequences(spark, sf_dir), 20)


@query("u01_concatenated_results", over_seqs("SELECT motif, count(*) AS n, round(sum(score), 4) AS total FROM hits GROUP BY motif", *HITS))
def u01(spark, sf_dir):
    rows, seqs = None, sequences(spark, sf_dir)
    for m in MOTIFS:
        part = scan.scan(seqs, [m], THRESHOLD)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("motif").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("j05_point_in_interval", over_seqs("SELECT seq_id, CAST(start AS BIGINT) AS start, CAST(g AS BIGINT) AS point FROM (SELECT seq_id, sum(length(seq)) OVER (ORDER BY seq_id) - length(seq) AS start, sum(length(seq)) OVER (ORDER BY seq_id) AS stop, sum(length(seq)) OVER () AS total FROM seqs) JOIN (SELECT unnest(range(0, 100000000, 997)) AS g) ON g >= start AND g < stop"))
def j05(spark, sf_dir):
    """The sequence that holds each 997th place of all sequences laid end to end: cells of both sides are joined by equality."""
    seqs = ordered.running_sums(sequences(spark, sf_dir).select("seq_id", F.length("seq").cast("long").alias("len")), "seq_id", ["len"])
    cell = 1 << 14
    spans = seqs.select("seq_id", F.col("before_len").cast("long").alias("start"), (F.col("before_len") + F.col("len")).cast("long").alias("stop"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("stop") - 1) / cell))))
    total = seqs.agg(F.sum("len")).first()[0] or 0
    points = spark.range(0, total, 997).select(F.col("id").alias("point"), F.floor(F.col("id") / cell).alias("cell"))
    return points.join(spans, "cell").where("point >= start AND point < stop").select("seq_id", "start", "point")


@query("x01_strand_symmetry", over_seqs(f"SELECT least(kmer, {rc('kmer')}) AS kmer, count(*) AS n FROM kmers6 GROUP BY 1", windows(6)))
def canonical(spark, sf_dir):
    return kmers.kmers_only(sequences(spark, sf_dir), 6).groupBy(dna.canonical("kmer").alias("kmer")).agg(F.count("*").alias("n"))
