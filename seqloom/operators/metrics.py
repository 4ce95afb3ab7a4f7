"""How well scores rank sequences: ROC and AUC, correlations, hit-rate tests. Ties are never broken: equal values share a rank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered, stats


def roc(scored: DataFrame) -> DataFrame:
    """(score, tp, fp, tpr, fpr) at each distinct score, from the greatest; scored: (score, label 0 or 1)."""
    steps = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    steps = steps.withColumn("_falling", -F.col("score"))
    total = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = ordered.running_sums(steps, "_falling", ["pos", "neg"]).crossJoin(F.broadcast(total))
    rows = rows.select("score", (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_neg") + F.col("neg")).alias("fp"), "p", "n")
    return rows.select("score", "tp", "fp", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"))


def auc(scored: DataFrame, by: str | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc) from the rank sum of the positives, without a loop over scores."""
    keys = [by] if by else []
    steps = scored.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    ranked = ordered.running_sums(steps, "score", ["n"], by=by)
    ranked = ranked.withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"), F.sum(F.col("pos") * F.col("rank")).alias("s"))
    return sums.select(*keys, "n_pos", "n_neg", ((F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    both = ordered.average_ranks(ordered.average_ranks(rows, x, "rank_x"), y, "rank_y")
    return both.agg(F.corr("rank_x", "rank_y").alias("spearman"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.corr(x, y).alias("pearson"))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, tn, fn at a threshold, and sn, spc, ppv, asp, cc of them.

    cc is the correlation coefficient with (TN + FN) in its denominator.
    """
    called = F.col("score") >= threshold
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    real = F.col("label") == 1
    row = scored.agg(count(called & real, "tp"), count(called & ~real, "fp"), count(~called & ~real, "tn"), count(~called & real, "fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    sn, ppv = tp / F.nullif(tp + fn, F.lit(0.0)), tp / F.nullif(tp + fp, F.lit(0.0))
    cc = (tp * tn - fn * fp) / F.nullif(F.sqrt((tp + fn) * (tn + fp) * (tp + fp) * (tn + fn)), F.lit(0.0))
    return row.select("tp", "fp", "tn", "fn", sn.alias("sn"), (tn / F.nullif(tn + fp, F.lit(0.0))).alias("spc"), ppv.alias("ppv"), ((sn + ppv) / 2).alias("asp"), cc.alias("cc"))


def enrichment(hits: DataFrame) -> DataFrame:
    """(motif, n_pos, n_neg, hit_pos, hit_neg, z): hit rates of labelled sequences, and the z-score of the positives' hits
    under the negatives' rate. hits: (motif, label, hit)."""
    c = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    pos, hit = F.col("label") == 1, F.col("hit")
    rows = hits.groupBy("motif").agg(c(pos, "n_pos"), c(~pos, "n_neg"), c(pos & hit, "hit_pos"), c(~pos & hit, "hit_neg"))
    p = (F.col("hit_neg") + 1) / (F.col("n_neg") + 2)
    return rows.withColumn("z", (F.col("hit_pos") - F.col("n_pos") * p) / F.sqrt(F.col("n_pos") * p * (1 - p)))


def hypergeometric(row) -> float:
    """Of a row of ``confusion``: the probability of so few false calls among those called, on the driver."""
    return 1 - stats.hypergeometric_cdf(row["tp"] - 1, row["tp"] + row["fp"] + row["tn"] + row["fn"], row["tp"] + row["fn"], row["tp"] + row["fp"])


def position_histogram(hits: DataFrame, bins: int, weight=None) -> DataFrame:
    """(motif, bin, n, p) of hits with columns pos, width, seq_len: the bin of each hit's middle."""
    middle = F.pmod(F.col("pos") + F.floor(F.col("width") / 2), F.col("seq_len"))
    w = F.lit(1.0) if weight is None else weight
    counts = hits.groupBy("motif", F.floor(bins * middle / F.col("seq_len")).cast("int").alias("bin")).agg(F.sum(w).alias("n"))
    total = counts.groupBy("motif").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), "motif").select("motif", "bin", "n", (F.col("n") / F.col("total")).alias("p"))


def chi_square(histogram: DataFrame, bins: int, first: int, last: int) -> DataFrame:
    """(motif, chi2, bins_used) of the bins from ``first`` to before ``last`` against their mean."""
    used = histogram.where((F.col("bin") >= first) & (F.col("bin") < last))
    sums = used.groupBy("motif").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    k = last - first
    return sums.select("motif", (F.col("q") / (F.col("s") / k) - F.col("s")).alias("chi2"), F.lit(k).alias("bins_used"))


def kolmogorov(values: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, ks): the largest distance of a group's values in [0, 1] from the uniform distribution, on both sides of each step."""
    steps = values.groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    total = steps.groupBy(by).agg(F.sum("_c").alias("_n"))
    rows = ordered.running_sums(steps, "_v", ["_c"], by=by).join(F.broadcast(total), by)
    low, high = F.col("before__c") / F.col("_n"), (F.col("before__c") + F.col("_c")) / F.col("_n")
    return rows.groupBy(by).agg(F.max("_n").alias("n"), F.max(F.greatest(F.abs(high - F.col("_v")), F.abs(low - F.col("_v")))).alias("ks"))


def geometric_windows(hits: DataFrame, first: float = 0.05, factor: float = 1.1) -> DataFrame:
    """(motif, k, radius, n_inside, odds, z) of windows around the sequences' centres that grow by a factor up to the whole.

    hits: (motif, away), the distance from the centre as a share of half the sequence. odds and z compare the hits inside a window
    with an even spread; windows are a few dozen rows a motif.
    """
    from pyspark.sql import Window

    last = max(1, math.ceil(math.log(1 / first) / math.log(factor)))
    k = F.when(F.col("away") <= first, 0).otherwise(F.least(F.ceil(F.log(F.col("away") / first) / math.log(factor) - 1e-9), F.lit(last))).cast("int")
    bins = hits.groupBy("motif", k.alias("k")).agg(F.count("*").alias("c"))
    every = bins.select("motif").distinct().select("motif", F.explode(F.sequence(F.lit(0), F.lit(last - 1))).alias("k"))
    total = bins.groupBy("motif").agg(F.sum("c").alias("t"))
    rows = every.join(bins, ["motif", "k"], "left").join(F.broadcast(total), "motif")
    inside = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("motif").orderBy("k"))  # a few dozen rows of a motif
    rows = rows.select("motif", "k", (first * F.pow(F.lit(factor), F.col("k"))).alias("radius"), inside.alias("n_inside"), "t")
    r, s, t = F.col("radius"), F.col("n_inside"), F.col("t")
    odds = F.try_divide(s, t - s) / (r / (1 - r))
    return rows.select("motif", "k", "radius", "n_inside", odds.alias("odds"), ((s - t * r) / F.sqrt(t * r * (1 - r))).alias("z"))
