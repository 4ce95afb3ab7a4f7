"""Queries of row-wise sequence operators, filters, k-mers and backgrounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import background, kmers
from ..sources.corpus import sequences, table
from .registry import over_seqs, query, rc, windows


def every(spark, sf_dir, k):
    """(kmer, n) of all sequences: distinct strings for the operators on single k-mers."""
    return kmers.count(sequences(spark, sf_dir), k)


def sql_every(k):
    return f"{windows(k)}, every AS (SELECT kmer, count(*) AS n FROM kmers{k} GROUP BY kmer)"


@query("x01_reverse_complement", over_seqs(f"SELECT seq_id, md5({rc('seq')}) AS rc_md5, {rc('seq')} = seq AS palindrome FROM seqs"))
def x01(spark, sf_dir):
    rcs = dna.reverse_complement("seq")
    return sequences(spark, sf_dir).select("seq_id", F.md5(rcs).alias("rc_md5"), (rcs == F.col("seq")).alias("palindrome"))


@query(
    "x02_kmer_explosion",
    over_seqs("SELECT seq_id, count(*) AS n, count(DISTINCT kmer) AS n_distinct, CAST(sum(pos) AS BIGINT) AS sum_pos, min(kmer) AS least, max(kmer) AS greatest FROM kmers8 GROUP BY seq_id", windows(8)),
)
def x02(spark, sf_dir):
    rows = kmers.explode(sequences(spark, sf_dir), 8)
    return rows.groupBy("seq_id").agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("n_distinct"), F.sum("pos").alias("sum_pos"), F.min("kmer").alias("least"), F.max("kmer").alias("greatest"))


_CODE = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(kmer) + 1), lambda i: CAST(strpos('ACGT', substr(kmer, i, 1)) - 1 AS BIGINT))), lambda a, b: a * 4 + b)"


@query("x03_kmer_code", over_seqs(f"SELECT DISTINCT kmer, {_CODE} AS code, kmer AS back FROM kmers6", windows(6)))
def x03(spark, sf_dir):
    return kmers.kmers_only(sequences(spark, sf_dir), 6).distinct().select("kmer", dna.code("kmer").alias("code"), dna.from_code(dna.code("kmer"), 6).alias("back"))


@query("x04_code_reverse_complement", over_seqs(f"SELECT DISTINCT {_CODE} AS code, {_CODE.replace('kmer', rc('kmer'))} AS rc_code FROM kmers6", windows(6)))
def x04(spark, sf_dir):
    return kmers.kmers_only(sequences(spark, sf_dir), 6).distinct().select(dna.code("kmer").alias("code"), dna.code(dna.reverse_complement(dna.from_code(dna.code("kmer"), 6))).alias("rc_code"))


_N = "substr(kmer, 1, 1) || 'N' || substr(kmer, 3, 2) || 'N' || substr(kmer, 6)"


@query(
    "x05_n_expansion",
    over_seqs(
        "SELECT pattern, substr(pattern, 1, 1) || a.b || substr(pattern, 3, 2) || c.b || substr(pattern, 6) AS kmer FROM p, (SELECT unnest(['A','C','G','T']) AS b) a, (SELECT unnest(['A','C','G','T']) AS b) c",
        sql_every(7),
        f"p AS (SELECT DISTINCT {_N} AS pattern FROM every)",
    ),
)
def x05(spark, sf_dir):
    patterns = every(spark, sf_dir, 7).select(F.expr(_N).alias("pattern")).distinct()
    return patterns.select("pattern", F.explode(dna.expansions("pattern")).alias("kmer"))


@query("x06_base_composition", over_seqs("SELECT seq_id, " + ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS BIGINT) AS n_{b.lower()}" for b in "ACGT") + " FROM seqs"))
def x06(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", *((F.length("seq") - F.length(F.replace("seq", F.lit(b)))).cast("long").alias(f"n_{b.lower()}") for b in "ACGT"))


@query(
    "x07_mismatch_neighbourhood",
    over_seqs(
        f"SELECT kmer, count(DISTINCT v) AS n_variants, min(v) AS least, max(v) AS greatest FROM (SELECT kmer, substr(s, 1, i - 1) || b || substr(s, i + 1) AS v FROM (SELECT kmer, unnest([kmer, {rc('kmer')}]) AS s FROM every), (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(['A','C','G','T']) AS b)) GROUP BY kmer",
        sql_every(5),
    ),
)
def x07(spark, sf_dir):
    found = every(spark, sf_dir, 5).select("kmer", dna.neighbours("kmer").alias("v"))
    return found.select("kmer", F.size("v").cast("long").alias("n_variants"), F.array_min("v").alias("least"), F.array_max("v").alias("greatest"))


@query(
    "x08_padded_site",
    over_seqs("SELECT seq_id, 'NNN' || substr(seq, 1, 7) AS head, rpad(substr(seq, length(seq) - 3), 10, 'N') AS tail, '' AS behind FROM seqs"),
)
def x08(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", dna.site("seq", F.lit(-3), 10).alias("head"), dna.site("seq", F.length("seq") - 4, 10).alias("tail"), dna.site("seq", F.length("seq") + 1, 10).alias("behind"))


@query(
    "x09_site_cleanup",
    over_seqs("SELECT kmer, CASE WHEN contains(substr(s, 1, 3), 'N') THEN 'NNN' || substr(s, 4) WHEN contains(substr(s, 4), 'N') THEN substr(s, 1, 3) || 'NNN' ELSE s END AS site FROM (SELECT kmer, replace(kmer, 'G', 'N') AS s FROM every)", sql_every(6)),
)
def x09(spark, sf_dir):
    return every(spark, sf_dir, 6).select("kmer", dna.cleaned_site(F.replace("kmer", F.lit("G"), F.lit("N"))).alias("site"))


@query("x10_sequence_entropy", over_seqs("SELECT seq_id, round(-sum(p * log2(p)), 6) AS bits FROM (SELECT seq_id, count(*) / sum(count(*)) OVER (PARTITION BY seq_id) AS p FROM kmers2 GROUP BY seq_id, kmer) GROUP BY seq_id", windows(2)))
def x10(spark, sf_dir):
    return kmers.entropy(sequences(spark, sf_dir), 2).select("seq_id", F.round("bits", 6).alias("bits"))


@query("f04_entropy_and_length", over_seqs("SELECT seq_id FROM (SELECT seq_id, count(*) / sum(count(*)) OVER (PARTITION BY seq_id) AS p, sum(count(*)) OVER (PARTITION BY seq_id) AS n FROM kmers2 GROUP BY seq_id, kmer) WHERE n >= 99 GROUP BY seq_id HAVING -sum(p * log2(p)) >= 3.5", windows(2)))
def f04(spark, sf_dir):
    return kmers.entropy(sequences(spark, sf_dir).where(F.length("seq") >= 100), 2).where("bits >= 3.5").select("seq_id")


_MASKS = ("TATTAA", "GATTA", "ACGT")


@query("x11_mask_sites", over_seqs("SELECT seq_id, md5(m) AS masked_md5, CAST(length(m) - length(replace(m, 'N', '')) AS BIGINT) AS n_masked FROM (SELECT seq_id, replace(replace(replace(seq, 'TATTAA', 'NNNNNN'), 'GATTA', 'NNNNN'), 'ACGT', 'NNNN') AS m FROM seqs)"))
def x11(spark, sf_dir):
    m = dna.masked("seq", F.array(*map(F.lit, _MASKS)))
    return sequences(spark, sf_dir).select("seq_id", m.alias("m")).select("seq_id", F.md5("m").alias("masked_md5"), (F.length("m") - F.length(F.replace("m", F.lit("N")))).cast("long").alias("n_masked"))


@query("x12_mask_centre", over_seqs("SELECT seq_id, md5(substr(seq, 1, length(seq) // 2 - 3) || 'XXXXXX' || substr(seq, length(seq) // 2 + 4)) AS masked_md5 FROM seqs"))
def x12(spark, sf_dir):
    middle = F.floor(F.length("seq") / 2).cast("int") - 3
    return sequences(spark, sf_dir).select("seq_id", F.md5(dna.overwritten("seq", middle, F.lit(6), "X")).alias("masked_md5"))


@query("x13_trim_empties", "SELECT event_id, array_to_string(list_filter(string_split(event_type || '__' || user_id || '_', '_'), lambda x: x <> ''), '|') AS parts FROM events")
def x13(spark, sf_dir):
    parts = F.split(F.concat_ws("", "event_type", F.lit("__"), "user_id", F.lit("_")), "_")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.filter(parts, lambda x: x != ""), "|").alias("parts"))


@query("x14_replace_and_join", over_seqs("SELECT kmer, 'Z' || substr(kmer, 2) AS replaced, array_to_string(string_split(kmer, ''), '-') AS joined FROM every", sql_every(5)))
def x14(spark, sf_dir):
    return every(spark, sf_dir, 5).select("kmer", F.overlay("kmer", F.lit("Z"), 1, 1).alias("replaced"), F.array_join(F.split("kmer", ""), "-").alias("joined"))


_DIFF = "len(list_filter([1, 2, 4, 6, 7, 8], lambda i: substr({0}, i, 1) <> substr('TANTNATA', i, 1)))"


@query(
    "f02_mismatch_search",
    over_seqs(f"SELECT seq_id, pos, CAST(least({_DIFF.format('kmer')}, {_DIFF.format(rc('kmer'))}) AS INTEGER) AS mismatches FROM kmers8 WHERE least({_DIFF.format('kmer')}, {_DIFF.format(rc('kmer'))}) <= 1", windows(8)),
)
def f02(spark, sf_dir):
    rows = kmers.explode(sequences(spark, sf_dir), 8)
    least = F.least(dna.mismatches_to("kmer", "TANTNATA"), dna.mismatches_to("kmer", "TATNANTA"))  # the pattern on either strand
    return rows.select("seq_id", F.col("pos").cast("long").alias("pos"), least.alias("mismatches")).where("mismatches <= 1")


@query("f03_hamming", over_seqs(f"SELECT seq_id, len(list_filter(list_zip(string_split(seq, ''), string_split({rc('seq')}, '')), lambda x: x[1] <> x[2])) AS distance FROM seqs"))
def f03(spark, sf_dir):
    """Places where a sequence differs from its reverse complement."""
    return sequences(spark, sf_dir).select("seq_id", dna.hamming("seq", dna.reverse_complement("seq")).cast("long").alias("distance"))


@query("f05_support", over_seqs("SELECT kmer, count(*) AS n, count(DISTINCT seq_id) AS n_seqs FROM kmers6 GROUP BY kmer HAVING count(*) >= 10 AND count(DISTINCT seq_id) >= 0.2 * (SELECT count(*) FROM seqs)", windows(6)))
def f05(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    rows = kmers.explode(seqs, 6).groupBy("kmer", "seq_id").agg(F.count("*").alias("c")).groupBy("kmer").agg(F.sum("c").alias("n"), F.count("*").alias("n_seqs"))
    total = seqs.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).where("n >= 10 AND n_seqs >= 0.2 * total").select("kmer", "n", "n_seqs")


@query("f10_centre_window", over_seqs("SELECT k.seq_id, k.pos FROM kmers6 k JOIN seqs s ON k.seq_id = s.seq_id WHERE k.kmer = 'TTATTA' AND abs(pos + 3 - length(seq) / 2) < 75", windows(6)))
def f10(spark, sf_dir):
    rows = kmers.explode(sequences(spark, sf_dir).withColumn("middle", F.length("seq") / 2), 6, "middle")
    return rows.where((F.col("kmer") == "TTATTA") & (F.abs(F.col("pos") + 3 - F.col("middle")) < 75)).select("seq_id", F.col("pos").cast("long").alias("pos"))


@query("a04_kmer_count", over_seqs("SELECT kmer, count(*) AS n FROM kmers6 GROUP BY kmer", windows(6)))
def a04(spark, sf_dir):
    return kmers.count(sequences(spark, sf_dir), 6)


@query(
    "a05_weighted_presence",
    over_seqs(f"SELECT kmer, count(*) AS n_seqs, round(avg(weight), 6) AS mean_weight FROM (SELECT DISTINCT seq_id, kmer, weight FROM (SELECT seq_id, kmer, weight FROM kmers6 UNION ALL SELECT seq_id, {rc('kmer')}, weight FROM kmers6)) GROUP BY kmer", windows(6)),
)
def a05(spark, sf_dir):
    return kmers.weighted_presence(sequences(spark, sf_dir), 6).select("kmer", "n_seqs", F.round("mean_weight", 6).alias("mean_weight"))


_COUNTS6 = "counts AS (SELECT kmer, count(*) AS n FROM kmers6 GROUP BY kmer)"


@query(
    "a06_neighbourhood_rollup",
    over_seqs("SELECT substr(kmer, 1, i - 1) || b || substr(kmer, i + 1) AS kmer, CAST(sum(n) AS BIGINT) AS n FROM counts, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(['A','C','G','T']) AS b) GROUP BY 1", windows(6), _COUNTS6),
)
def a06(spark, sf_dir):
    return kmers.neighbourhood(kmers.count(sequences(spark, sf_dir), 6), 6)


@query("a06_masked_rollup", over_seqs("SELECT substr(kmer, 1, i - 1) || 'NNN' || substr(kmer, i + 3) AS pattern, CAST(sum(n) AS BIGINT) AS n FROM counts, (SELECT unnest(range(1, 5)) AS i) GROUP BY 1", windows(6), _COUNTS6))
def a06_masked(spark, sf_dir):
    return kmers.masked_counts(kmers.count(sequences(spark, sf_dir), 6), 6)


def model_sql(order: int, weight: str = "1.0", name: str = "model") -> str:
    """Common tables that fit a background model on seqs: <name>(prefix, p)."""
    parts = " UNION ALL ".join(f"SELECT substr(s, i, {k}) AS prefix, w FROM (SELECT s, w, unnest(range(1, length(s) - {k - 2})) AS i FROM strands_{name})" for k in range(1, order + 2))
    names = []
    for k in range(1, order + 2):
        froms = ", ".join(f"(SELECT unnest(['A','C','G','T']) AS b) t{i}" for i in range(k))
        names.append(f"SELECT {' || '.join(f't{i}.b' for i in range(k))} AS prefix FROM {froms}")
    return f"""strands_{name} AS (SELECT seq AS s, {weight} AS w FROM seqs UNION ALL SELECT {rc('seq')}, {weight} FROM seqs),
counts_{name} AS (SELECT n.prefix, coalesce(c.n, 0) + pow(4.0, -length(n.prefix)) AS n FROM ({' UNION ALL '.join(names)}) n LEFT JOIN (SELECT prefix, sum(w) AS n FROM ({parts}) GROUP BY prefix) c ON n.prefix = c.prefix),
{name} AS (SELECT prefix, n / sum(n) OVER (PARTITION BY substr(prefix, 1, length(prefix) - 1)) AS p FROM counts_{name})"""


@query("a07_background_model", over_seqs("SELECT prefix, round(p, 9) AS p FROM model", model_sql(2)))
def a07(spark, sf_dir):
    return background.fit(sequences(spark, sf_dir), 2).select("prefix", F.round("p", 9).alias("p"))


@query("a08_weighted_background", over_seqs("SELECT prefix, round(p, 9) AS p FROM model", model_sql(1, "weight")))
def a08(spark, sf_dir):
    return background.fit(sequences(spark, sf_dir), 1, "weight").select("prefix", F.round("p", 9).alias("p"))


@query(
    "a09_flank_model",
    over_seqs(
        f"SELECT kmer, col, base, count(*) AS n FROM (SELECT kmer, CAST(i AS INTEGER) - 3 AS col, substr(around, i + 1, 1) AS base FROM (SELECT kmer, around, unnest(range(0, 10)) AS i FROM (SELECT kmer, around FROM sites UNION ALL SELECT {rc('kmer')}, reverse(translate(around, 'ACGTN', 'TGCAN')) FROM sites))) WHERE base <> 'N' GROUP BY ALL",
        "sites AS (SELECT substr(p, pos + 4, 4) AS kmer, substr(p, pos + 1, 10) AS around FROM (SELECT 'NNN' || seq || 'NNN' AS p, unnest(range(0, length(seq) - 3)) AS pos FROM seqs))",
    ),
)
def a09(spark, sf_dir):
    return background.flanks(sequences(spark, sf_dir), 4, 3)


@query(
    "a10_sequence_log_probability",
    over_seqs("SELECT seq_id, round(sum(ln(p)), 4) AS logp FROM (SELECT seq_id, substr(seq, greatest(i - 2, 1), least(i, 3)) AS prefix FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs)) JOIN model USING (prefix) GROUP BY seq_id", model_sql(2)),
)
def a10(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    return background.log_probability(seqs, background.fit(seqs, 2), 2).select("seq_id", F.round("logp", 4).alias("logp"))


_SEEDS = """SELECT kmer, n, round(e, 6) AS expected, round(n / e, 6) AS odds FROM (SELECT c.kmer, c.n, (SELECT sum(n) FROM counts) * a.p * b.p * {more} AS e FROM counts c
JOIN model a ON a.prefix = substr(c.kmer, 1, 1) JOIN model b ON b.prefix = substr(c.kmer, 1, 2) {joins}) WHERE n > e ORDER BY odds DESC, kmer LIMIT 25"""
_SEEDS = _SEEDS.format(more=" * ".join(f"m{i}.p" for i in range(4)), joins=" ".join(f"JOIN model m{i} ON m{i}.prefix = substr(c.kmer, {i + 1}, 3)" for i in range(4)))


@query("t04_seeds", over_seqs(_SEEDS, windows(6), _COUNTS6, model_sql(2)))
def t04(spark, sf_dir):
    """The 25 k-mers with the greatest ratio of observed to expected counts: the flagship query."""
    seqs = sequences(spark, sf_dir)
    return kmers.over_represented(kmers.count(seqs, 6), background.fit(seqs, 2), 6, 2, 25)


@query("f06_over_representation", over_seqs(_SEEDS.replace("ORDER BY odds DESC, kmer LIMIT 25", "AND round(n / e, 6) > 1.09").replace(", round(e, 6) AS expected, round(n / e, 6) AS odds", ""), windows(6), _COUNTS6, model_sql(2)))
def f06(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    return kmers.represented(kmers.count(seqs, 6), background.fit(seqs, 2), 6, 2).where("odds > 1.09").select("kmer", "n")


@query("a29_coverage", over_seqs("SELECT kmer, count(DISTINCT seq_id) AS n_seqs FROM kmers6 GROUP BY kmer", windows(6)))
def a29(spark, sf_dir):
    return kmers.weighted_presence(sequences(spark, sf_dir), 6, both_strands=False).select("kmer", "n_seqs")


@query(
    "w02_non_overlapping_count",
    over_seqs("SELECT kmer, CAST(sum(CASE WHEN last IS NULL OR pos - last > 6 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT kmer, pos, lag(pos) OVER (PARTITION BY seq_id, kmer ORDER BY pos) AS last FROM kmers6) GROUP BY kmer", windows(6)),
)
def w02(spark, sf_dir):
    """Each occurrence more than 6 behind the one before it counts, whether that one counted or not."""
    from pyspark.sql import Window

    last = F.lag("pos").over(Window.partitionBy("seq_id", "kmer").orderBy("pos"))
    rows = kmers.explode(sequences(spark, sf_dir), 6).withColumn("last", last)
    return rows.groupBy("kmer").agg(F.sum(F.when(F.col("last").isNull() | (F.col("pos") - F.col("last") > 6), 1).otherwise(0)).alias("n"))


@query("u02_union_distinct", over_seqs(f"SELECT kmer FROM (SELECT DISTINCT kmer FROM kmers6 UNION SELECT DISTINCT {rc('kmer')} FROM kmers6)", windows(6)))
def u02(spark, sf_dir):
    own = kmers.kmers_only(sequences(spark, sf_dir), 6).distinct()
    return own.union(own.select(dna.reverse_complement("kmer").alias("kmer"))).distinct()


@query(
    "u04_disjoint_groups",
    over_seqs("SELECT kmer, list_has_any(list_slice(g, 1, 3), list_slice(g, 4, 6)) AS overlap FROM (SELECT kmer, [substr(kmer, 1, 1), substr(kmer, 2, 1), substr(kmer, 3, 1), substr(kmer, 4, 1), substr(kmer, 5, 1), substr(kmer, 6, 1)] AS g FROM every)", sql_every(6)),
)
def u04(spark, sf_dir):
    g = F.split("kmer", "")
    return every(spark, sf_dir, 6).select("kmer", F.arrays_overlap(F.slice(g, 1, 3), F.slice(g, 4, 3)).alias("overlap"))
