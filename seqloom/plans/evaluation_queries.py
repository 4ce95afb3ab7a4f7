"""Queries of searches, verification, learning, and of files written and read again."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from ..functions import dna, stats
from ..operators import background, em, kmers, learn, sampling, scan, search, thresholds
from ..operators.motifs import Motif
from ..sources import motif_files, sinks, text
from ..sources.corpus import letters, sequences, table
from .model_queries import _TOP, LIBRARY, UNIFORM, _divergence_sql, instances_sql, model_rows, motif_values, planted_sql
from .registry import over_seqs, query, rc, recursive, windows
from .scan_queries import HITS, MOTIFS, SCORED, best, hits, log_choose, shared
from .scratch import folder, kept
from .sequence_queries import _COUNTS6, _SEEDS, model_sql


@query("s01_fasta", over_seqs("SELECT CAST(seq_id AS VARCHAR) AS name, md5(seq) AS seq_md5, CAST(length(seq) AS INTEGER) AS len FROM seqs"))
def s01(spark, sf_dir):
    path = folder(spark)
    sinks.write_fasta(sequences(spark, sf_dir), path)
    return text.fasta(spark, path).select("name", F.md5("seq").alias("seq_md5"), F.length("seq").alias("len"))


@query("s03_clean_controls", over_seqs("SELECT seq_id, md5(seq) AS seq_md5 FROM seqs WHERE seq_id NOT IN (SELECT seq_id FROM kmers30 JOIN (SELECT DISTINCT substr(seq, p + 1, 30) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - 29)) AS p FROM (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark))) USING (kmer))", windows(30)))
def s03(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    left = seqs.join(shared(spark, sf_dir, seqs, 30), "seq_id", "left_anti")
    return left.select("seq_id", F.md5("seq").alias("seq_md5"))


@query("s04_intensities", over_seqs("SELECT substr(seq, 1, 35) AS seq, round(weight / avg(weight) OVER (), 6) AS weight FROM seqs"))
def s04(spark, sf_dir):
    path = folder(spark)
    sequences(spark, sf_dir).select(F.concat_ws("\t", F.col("weight").cast("string"), "seq")).write.text(path)
    return text.intensities(spark, path).select("seq", F.round("weight", 6).alias("weight"))


@query("s08_signal_bins", "SELECT vec_id, CAST(i // 8 AS INTEGER) AS bin, round(sum(x), 4) AS total FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(list_transform(embedding, lambda e: round(e, 6)::DOUBLE)) AS x FROM embeddings) GROUP BY 1, 2")
def s08(spark, sf_dir):
    path = folder(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.array_join(F.concat(F.array(F.col("vec_id").cast("string")), F.transform("embedding", lambda x: F.round(x, 6).cast("double").cast("string"))), "\t"))
    rows.write.text(path)
    signal = text.matrix(spark, path).select(F.col("values")[0].cast("long").alias("seq_id"), F.slice(F.col("values"), F.lit(2), F.size("values")).alias("values"))
    return text.signal_bins(signal, 8).select(F.col("seq_id").alias("vec_id"), "bin", F.round("total", 4).alias("total"))


def library_sql(rows: list[Motif] = LIBRARY, digits: int = 5) -> str:
    return f"WITH {motif_values('lib', rows)} SELECT motif, col, base, round(CASE base WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END, {digits}) AS w FROM lib, (SELECT unnest(['A', 'C', 'G', 'T']) AS base)"


@query("s10_motif_file", library_sql())
def s10(spark, sf_dir):
    path = folder(spark) + "/library.pwm"
    sinks.write_motifs(spark, LIBRARY, path, by_score=True)
    return motif_files.read_table(spark, path).select("motif", "col", "base", F.round("w", 5).alias("w"))


@query("s23_background_file", over_seqs("SELECT prefix, round(p, 9) AS p FROM model", model_sql(1)))
def s23(spark, sf_dir):
    path = folder(spark)
    sinks.write_background(background.fit(sequences(spark, sf_dir), 1), path, 1)
    return motif_files.read_background(spark, path).select("prefix", F.round("p", 9).alias("p"))


@query("s25_answers", over_seqs("SELECT seq_id, CAST(pos AS BIGINT) AS pos FROM hits WHERE motif = 'm2'", *HITS))
def s25(spark, sf_dir):
    path = folder(spark)
    hits(spark, sf_dir, "m2").select(F.concat_ws("\t", "motif", F.lit("site"), F.col("seq_id").cast("string"), F.col("pos").cast("string"))).write.text(path)
    return text.answers(spark, path)


@query("s27_name_index", "SELECT substr(url, 1, 24) AS key, min(page_id) AS seq_id FROM pages GROUP BY 1")
def s27(spark, sf_dir):
    return text.name_index(table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq_id"), F.col("url").alias("name")))


@query("s29_control_intervals", "SELECT doc_id, side, a, b FROM (SELECT doc_id, 'right' AS side, n_chars + 300 AS a, n_chars + doc_id + 300 AS b FROM documents UNION ALL SELECT doc_id, 'left', n_chars - 300, n_chars + doc_id - 300 FROM documents WHERE n_chars - 300 > 0 AND n_chars + doc_id - 300 > 0)")
def s29(spark, sf_dir):
    path = folder(spark)
    rows = table(spark, sf_dir, "documents").select(F.concat_ws(" ", F.concat(F.lit("d"), "doc_id"), F.col("n_chars").cast("string"), (F.col("n_chars") + F.col("doc_id")).cast("string")))
    rows.write.text(path)
    moved = text.flanking(text.peaks(spark, path), 100)
    return moved.select(F.substring("chrom", 2, 20).cast("long").alias("doc_id"), "side", F.col("coords")[0].alias("a"), F.col("coords")[1].alias("b"))


@query("k05_position_file", over_seqs("SELECT substr(q.seq, pos + 1, 6) AS site, CAST(h.seq_id AS VARCHAR) AS seq, CAST(pos AS INTEGER) AS pos, CASE WHEN reverse THEN '-' ELSE '+' END AS strand FROM hits h JOIN seqs q ON q.seq_id = h.seq_id WHERE motif = 'm1'", *HITS))
def k05(spark, sf_dir):
    path = folder(spark)
    sinks.write_positions(hits(spark, sf_dir, "m1"), sequences(spark, sf_dir), 6, path)
    return spark.read.option("sep", "\t").option("header", True).csv(path).select("site", "seq", F.col("pos").cast("int").alias("pos"), "strand")


@query("k10_masked_fasta", over_seqs("SELECT CAST(seq_id AS VARCHAR) AS name, md5(replace(replace(seq, 'TAATTA', '------'), 'GATTAC', '------')) AS masked_md5 FROM seqs"))
def k10(spark, sf_dir):
    path = folder(spark)
    masked = dna.masked("seq", F.array(F.lit("TAATTA"), F.lit("GATTAC")), "-")
    sinks.write_fasta(sequences(spark, sf_dir).select("seq_id", masked.alias("seq")), path)
    return text.fasta(spark, path).select("name", F.md5(F.translate("seq", "N", "-")).alias("masked_md5"))


@query("k11_simulated_answers", over_seqs("SELECT seq_id, CAST(pos AS BIGINT) AS pos FROM planted WHERE pos IS NOT NULL", *planted_sql(MOTIFS[1], 0.5, 13)))
def k11(spark, sf_dir):
    """Sites planted in every second sequence, written as truth and read back."""
    path = folder(spark)
    sinks.write_answers(sampling.planted(sequences(spark, sf_dir).select("seq_id", "seq"), MOTIFS[1], 0.5, 13), "m2", path)
    return text.answers(spark, path)


@query("k09_pair_matrix", _divergence_sql("SELECT m AS motif, " + ", ".join(f"round(max(d) FILTER (o = '{m.name}'), 6) AS {m.name}" for m in LIBRARY) + " FROM (SELECT m1 AS m, m2 AS o, d FROM div UNION ALL SELECT m2, m1, d FROM div UNION ALL SELECT DISTINCT motif, motif, 0.0 FROM lib) GROUP BY m"))
def k09(spark, sf_dir):
    """Divergence of every two library motifs, as a matrix with a column for each motif."""
    from ..operators.motifs import divergence

    rows = [(a.name, b.name, round(divergence(a, b), 6)) for a in LIBRARY for b in LIBRARY]
    return spark.createDataFrame(rows, "motif string, other string, d double").groupBy("motif").pivot("other", [m.name for m in LIBRARY]).agg(F.first("d"))


@query("t02_entries_by_value", over_seqs("SELECT kmer, n, row_number() OVER (ORDER BY n DESC, kmer) AS place FROM (SELECT kmer, count(*) AS n FROM kmers4 GROUP BY kmer)", windows(4)))
def t02(spark, sf_dir):
    from pyspark.sql import Window

    rows = kmers.count(sequences(spark, sf_dir), 4)  # 256 rows
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "kmer")).cast("long"))


@query("t03_entries_ascending", over_seqs("SELECT kmer, n FROM (SELECT kmer, count(*) AS n FROM kmers6 GROUP BY kmer) ORDER BY n, kmer LIMIT 50", windows(6)))
def t03(spark, sf_dir):
    return kmers.count(sequences(spark, sf_dir), 6).orderBy("n", "kmer").limit(50)


@query(
    "t05_gapped_seeds",
    over_seqs(
        'SELECT "left", "right", n, round(n * t / (nl * nr), 6) AS odds FROM (SELECT "left", "right", n, sum(n) OVER (PARTITION BY "left") AS nl, sum(n) OVER (PARTITION BY "right") AS nr, sum(n) OVER () AS t FROM (SELECT substr(kmer, 1, 3) AS "left", substr(kmer, 6, 3) AS "right", count(*) AS n FROM kmers8 GROUP BY 1, 2)) WHERE n >= 10 ORDER BY odds DESC, "left", "right" LIMIT 20',
        windows(8),
    ),
)
def t05(spark, sf_dir):
    return search.gapped_seeds(sequences(spark, sf_dir), 3, 2, 20)


_GAPS = "110110110011"
_WORD = " || ".join(f"substr(kmer, {i + 1}, 1)" for i, c in enumerate(_GAPS) if c == "1")


@query(
    "t05_three_gaps",
    over_seqs(
        "SELECT "
        + " || ".join(f"substr(word, {_GAPS[:i].count('1') + 1}, 1)" if c == "1" else "'N'" for i, c in enumerate(_GAPS))
        + " AS seed, n, round(n / (total * p), 6) AS odds FROM (SELECT word, n, sum(n) OVER () AS total, "
        + " * ".join(f"(SELECT p FROM model WHERE prefix = substr(word, {j + 1}, 1))" for j in range(_GAPS.count("1")))
        + f" AS p FROM (SELECT {_WORD} AS word, count(*) AS n FROM kmers{len(_GAPS)} GROUP BY 1)) WHERE n >= 10 ORDER BY odds DESC, seed LIMIT 20",
        windows(len(_GAPS)),
        model_sql(0),
    ),
)
def t05_three(spark, sf_dir):
    """Seeds of four pairs of letters with three gaps between them."""
    seqs = sequences(spark, sf_dir)
    p = {r["prefix"]: r["p"] for r in background.fit(seqs, 0).collect()}
    return search.spaced_seeds(seqs, _GAPS, p, 20)


_NEAR = "len(list_filter(range(1, 7), lambda i: substr({0}, i, 1) <> substr({1}, i, 1))) < 2"


@query(
    "t05_diverse_seeds",
    recursive(
        over_seqs(
            "SELECT CAST(i AS INTEGER) AS place, kmer FROM (SELECT unnest(kept) AS kmer, unnest(range(0, len(kept))) AS i FROM (SELECT kept FROM picked ORDER BY k DESC LIMIT 1))",
            windows(6),
            _COUNTS6,
            model_sql(2),
            f"odds AS ({_SEEDS.replace('LIMIT 25', '')})",
            "ranked AS (SELECT kmer, row_number() OVER (ORDER BY odds DESC, kmer) AS k FROM odds)",
            f"picked AS (SELECT 1::BIGINT AS k, []::VARCHAR[] AS kept UNION ALL SELECT p.k + 1, CASE WHEN len(list_filter(p.kept, lambda s: {_NEAR.format('r.kmer', 's')} OR {_NEAR.format('r.kmer', rc('s'))})) = 0 THEN list_append(p.kept, r.kmer) ELSE p.kept END FROM picked p JOIN ranked r USING (k) WHERE len(p.kept) < 12)",
        )
    ),
)
def t05_diverse(spark, sf_dir):
    """The best seeds that differ from each other; the ranking has 4 ** 6 rows at most and is gone through to its end if need be."""
    seqs = sequences(spark, sf_dir)
    ranked = [r["kmer"] for r in kmers.represented(kmers.count(seqs, 6), background.fit(seqs, 2), 6, 2).orderBy(F.desc("odds"), "kmer").collect()]
    return spark.createDataFrame(list(enumerate(search.diverse(ranked, 2, 12))), "place int, kmer string")


@query("t10_limited", over_seqs("SELECT motif, seq_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY score DESC, seq_id) AS k FROM best) WHERE k <= 5", *SCORED, "best AS (SELECT seq_id, motif, max(score) AS score FROM scored GROUP BY ALL)"))
def t10(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("motif").orderBy(F.desc("score"), "seq_id"))
    return best(spark, sf_dir).withColumn("k", k).where("k <= 5").select("motif", "seq_id", F.round("score", 6).alias("score"))


@query("t11_repeated_argmax", over_seqs(f"SELECT kmer, n FROM (SELECT least(kmer, {rc('kmer')}) AS kmer, count(*) AS n FROM kmers6 GROUP BY 1) ORDER BY n DESC, kmer LIMIT 10", windows(6)))
def t11(spark, sf_dir):
    return search.canonical_counts(sequences(spark, sf_dir), 6).orderBy(F.desc("n"), "kmer").limit(10)


@query(
    "a27_binomial_similarity",
    over_seqs(
        f"""SELECT m1, m2, n_near, round(CASE WHEN n_near = 0 THEN 1.0 ELSE least(1.0, (SELECT coalesce(sum(exp({log_choose('n', 'k')} + k * ln(p) + (n - k) * ln(1 - p))), 0) FROM (SELECT unnest(range(n_near, n + 1)) AS k))) END, 6) AS p FROM (SELECT x.motif AS m1, y.motif AS m2, x.n, least(1.0, 11 * y.n / total) AS p,
  (SELECT count(DISTINCT (a.seq_id, a.pos)) FROM hits a JOIN hits b ON a.seq_id = b.seq_id AND abs(a.pos - b.pos) <= 5 WHERE a.motif = x.motif AND b.motif = y.motif) AS n_near FROM sizes x JOIN sizes y ON x.motif < y.motif, (SELECT sum(length(seq)) AS total FROM seqs))""",
        *HITS,
        "sizes AS (SELECT motif, count(*) AS n FROM hits GROUP BY motif)",
    ),
)
def a27(spark, sf_dir):
    """How unlikely it is that so many hits of one motif lie near hits of another by chance."""
    from ..operators import positions

    found = kept(hits(spark, sf_dir).select("motif", "seq_id", "pos"))
    total = sequences(spark, sf_dir).agg(F.sum(F.length("seq"))).first()[0] or 1
    n = {r["motif"]: r["n"] for r in found.groupBy("motif").agg(F.count("*").alias("n")).collect()}
    rows = []
    for i, a in enumerate(MOTIFS):
        for b in MOTIFS[i + 1 :]:
            near = positions.near(found.where(F.col("motif") == a.name), found.where(F.col("motif") == b.name), "seq_id", "pos", 5).select("seq_id", "a").distinct().count()
            p = min(1.0, 11 * n.get(b.name, 0) / total)
            rows.append((a.name, b.name, near, round(stats.binomial_tail(near, n.get(a.name, 0), p), 6)))
    return spark.createDataFrame(rows, "m1 string, m2 string, n_near long, p double")


_ANSWERS = "answers AS (SELECT seq_id, pos FROM hits WHERE motif = 'm1'), predicted AS (SELECT reverse AS list_id, seq_id, pos FROM hits WHERE motif = 'm3')"


@query(
    "a32_verification",
    over_seqs(
        "SELECT p.list_id, p.n_predicted, coalesce(f.n_found, 0) AS n_found, t.n_answers, round(coalesce(f.hit, 0) / p.n_predicted, 6) AS precision, round(coalesce(f.n_found, 0) / t.n_answers, 6) AS recall FROM (SELECT list_id, count(*) AS n_predicted FROM predicted GROUP BY 1) p LEFT JOIN (SELECT list_id, count(DISTINCT (x.seq_id, x.pos)) AS hit, count(DISTINCT (a.seq_id, a.pos)) AS n_found FROM predicted x JOIN answers a ON a.seq_id = x.seq_id AND abs(a.pos - x.pos) < 5 GROUP BY 1) f USING (list_id), (SELECT count(*) AS n_answers FROM answers) t",
        *HITS,
        _ANSWERS,
    ),
)
def a32(spark, sf_dir):
    found = kept(hits(spark, sf_dir, "m1", "m3"))
    rows = search.verification(found.where("motif = 'm1'"), found.where("motif = 'm3'").withColumn("list_id", F.col("reverse")), 5)
    return rows.select("list_id", "n_predicted", "n_found", "n_answers", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "a33_seed_recall",
    over_seqs(
        "SELECT (SELECT count(DISTINCT motif) FROM known) AS n_motifs, count(DISTINCT motif) AS n_found, count(DISTINCT kmer) AS n_seeds, count(DISTINCT substr(motif, 1, 3)) AS n_families, count(*) AS n_matches, round(count(DISTINCT motif) / (SELECT count(DISTINCT motif) FROM known), 6) AS recall, round(count(DISTINCT motif) / nullif(count(DISTINCT substr(motif, 1, 3)), 0), 6) AS a_family, round(count(*) / nullif(count(DISTINCT motif), 0), 6) AS abundance, round(count(*) / nullif(count(DISTINCT kmer), 0), 6) AS redundancy FROM known JOIN seeds ON contains(site, kmer)",
        windows(6),
        _COUNTS6,
        model_sql(2),
        f"seeds AS ({_SEEDS})",
        "known AS (SELECT DISTINCT substr(site, 1, 9) AS motif, site FROM (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS site FROM benchmark) WHERE length(site) >= 9)",
    ),
)
def a33(spark, sf_dir):
    """How well the 25 best seeds find known sites: the benchmark's, named by their first nine letters."""
    seqs = sequences(spark, sf_dir)
    seeds = kmers.over_represented(kmers.count(seqs, 6), background.fit(seqs, 2), 6, 2, 25)
    site = letters("text")
    known = table(spark, sf_dir, "benchmark").select(F.substring(site, 1, 9).alias("motif"), site.alias("site")).where(F.length("site") >= 9)
    return search.recall(seeds, known, 6)


@query("r04_background_sets")
def r04(spark, sf_dir):
    """Two random sequences as long as each sequence, from the fitted background."""
    seqs = sequences(spark, sf_dir)
    model = {r["prefix"]: r["p"] for r in background.fit(seqs, 1).collect()}
    lengths = seqs.select((F.col("seq_id") * 2).alias("seq_id"), F.length("seq").alias("len"))
    lengths = lengths.union(lengths.select(F.col("seq_id") + 1, "len"))
    return sampling.markov_sequences(lengths, model, 1, 21).select("seq_id", F.length("seq").alias("len"), F.md5("seq").alias("seq_md5"))


_CDF = ", ".join(f"('{m.name}', {c}, {', '.join(f'{x!r}::DOUBLE' for x in row[:3])})" for m in LIBRARY for c, row in enumerate(sampling.running(m).tolist()))


@query(
    "r07_random_sites",
    f"SELECT motif, CAST(draw AS INTEGER) AS draw, string_agg(CASE WHEN u < x THEN 'A' WHEN u < y THEN 'C' WHEN u < z THEN 'G' ELSE 'T' END, '' ORDER BY col) AS site FROM (SELECT *, CAST(('0x' || substr(md5('3:' || motif || ':' || draw || ':' || col), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM (VALUES {_CDF}) t(motif, col, x, y, z), (SELECT unnest(range(0, 5)) AS draw)) GROUP BY motif, draw",
)
def r07(spark, sf_dir):
    return spark.createDataFrame([(m.name, i, sampling.random_site(m, 3, f"{m.name}:{i}")) for m in LIBRARY for i in range(5)], "motif string, draw int, site string")


@query(
    "r08_sampling_efficiency",
    over_seqs("SELECT CAST(k AS INTEGER) AS k, count(*) AS n_drawn, count(*) FILTER (score >= -4) AS n_good FROM (SELECT score, CAST(('0x' || substr(md5('5:' || seq_id || ':' || pos), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM scored WHERE motif = 'm1'), (SELECT unnest(range(1, 11)) AS k) WHERE u < least(1.0, exp(score + 6 * ln(4.0)) * pow(2.0, -k)) GROUP BY k", *SCORED),
)
def r08(spark, sf_dir):
    """Windows that a likelihood sample draws at falling ratios, and the share of good hits among them."""
    rows = scan.scan(sequences(spark, sf_dir), [MOTIFS[0]], None).withColumn("u", sampling.uniform(5, F.concat_ws(":", "seq_id", "pos")))
    gain = F.exp(F.col("score") + 6 * F.log(F.lit(4.0)))
    ratios = spark.createDataFrame([(k, 2.0**-k) for k in range(1, 11)], "k int, ratio double")
    drawn = rows.crossJoin(F.broadcast(ratios)).where(F.col("u") < F.least(F.lit(1.0), gain * F.col("ratio")))
    return drawn.groupBy("k").agg(F.count("*").alias("n_drawn"), F.count_if(F.col("score") >= -4).alias("n_good"))


@query("r09_instance_set", f"WITH {', '.join(instances_sql(0.8, LIBRARY[:2]))} SELECT motif, kmer AS site, round(p, 9) AS p FROM taken")
def r09(spark, sf_dir):
    rows = [(m.name, s, round(p, 9)) for m in LIBRARY[:2] for s, p in thresholds.instances(m, 0.8)]
    return spark.createDataFrame(rows, "motif string, site string, p double")


@query("e06_erasing_em")
def e06(spark, sf_dir):
    """Two motifs in turn: a window counts less for the second one, the likelier its letters belong to a site of the first."""
    seqs = kept(sequences(spark, sf_dir).select("seq_id", "seq"))
    first = em.fit(seqs, [em.State(Motif.of_consensus("first", "TAATTA", 0.7))], UNIFORM, rounds=4)[0]
    left = kept(em.erasing(seqs, em.sites(seqs, first, UNIFORM)))
    second = em.fit(left, [em.State(Motif.of_consensus("second", "GATNATC", 0.7))], UNIFORM, rounds=4, erased="erased")[0]
    return model_rows(spark, [first, second])


@query("e07_hill_climb")
def e07(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    q = {r["prefix"]: r["p"] for r in background.fit(seqs, 0).collect()}
    counts = kmers.count(seqs, 6).persist()
    columns, z = search.hill_climb(counts, "TAATTA", q, 6)
    counts.unpersist()
    return spark.createDataFrame([(i, c, round(z, 6)) for i, c in enumerate(columns)], "col int, bases string, z double")


@query("e08_merged_motifs")
def e08(spark, sf_dir):
    a, b = (Motif(m.name, m.weights, 2.0 - i) for i, m in enumerate((LIBRARY[0], LIBRARY[3])))
    return model_rows(spark, [em.State(search.merge(a, b))])


@query("e11_smoothed_flank")
def e11(spark, sf_dir):
    """A motif's columns smoothed by the sequences' own chain of bases."""
    p = {r["prefix"]: r["p"] for r in background.fit(sequences(spark, sf_dir), 1).collect()}
    chain = np.array([[p[a + b] for b in "ACGT"] for a in "ACGT"])
    rows = search.smoothed_flank(MOTIFS[1].weights, chain, np.array([p[b] for b in "ACGT"]))
    return spark.createDataFrame([(c, *(round(float(x), 6) for x in r)) for c, r in enumerate(rows)], "col int, a double, c double, g double, t double")


@query("c06_dependency_groups")
def c06(spark, sf_dir):
    """Disjoint groups of columns of a motif's hits, on the hits' own strand, whose joint frequencies are worth most: pairs of any
    two columns first, then the sets whose pairs all gain, and of these the best within a budget of columns."""
    from ..operators import cluster

    motif, keep, cost = MOTIFS[2], 7, 0.01
    width = len(motif)
    rows = scan.scan(sequences(spark, sf_dir), [motif], -8.0, sites=True)
    sites = kept(rows.select(F.when(F.col("reverse"), dna.reverse_complement("site")).otherwise(F.col("site")).alias("site")))
    single = cluster.joint_counts(sites, [(c,) for c in range(width)])
    score = {}

    def judge(groups):
        for g, words in cluster.joint_counts(sites, groups).items():
            score[frozenset(g)] = cluster.dependence_score(words, [single[(c,)] for c in g], keep) - cost * (len(g) - 1)

    judge(list(itertools.combinations(range(width), 2)))
    judge([tuple(sorted(c)) for c in search.cliques({e for e, x in score.items() if x > 0}, 3) if len(c) > 2])
    return spark.createDataFrame([("-".join(map(str, sorted(g))), round(score[g], 6)) for g in search.dependency_groups(score, 6)], "columns string, score double")


_JOINT = "substr({0}, 2, 1) || substr({0}, 5, 1)"
_SINGLE = " + ".join("list_extract([" + ", ".join(f"{float(x)!r}::DOUBLE" for x in MOTIFS[0].logs[c]) + f"], strpos('ACGT', substr({{0}}, {c + 1}, 1)))" for c in (0, 2, 3, 5))
_JOINT_LOG = "coalesce((SELECT ln(p) FROM words WHERE word = {0}), (SELECT ln(max(p) / 9) FROM words WHERE word = 'N'))".format(_JOINT)


@query(
    "c08_gap_motif",
    over_seqs(
        "SELECT 'm1' AS motif, count(*) AS n, round(avg(score), 6) AS mean_score, 19 AS parameters FROM (SELECT seq_id, max(score) AS score FROM kmers6 JOIN paired USING (kmer) GROUP BY seq_id)",
        windows(6),
        f"ranked AS (SELECT w, n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n DESC, w) AS r FROM (SELECT {_JOINT.format('kmer')} AS w, count(*) AS n FROM kmers6 GROUP BY 1))",
        "words AS (SELECT CASE WHEN r <= 7 THEN w ELSE 'N' END AS word, sum(p) AS p FROM ranked GROUP BY 1)",
        f"strands AS (SELECT kmer, unnest([kmer, {rc('kmer')}]) AS s FROM (SELECT DISTINCT kmer FROM kmers6))",
        f"paired AS (SELECT kmer, max(round({_SINGLE.format('s')} + {_JOINT_LOG.format('s')}, 9)) AS score FROM strands GROUP BY kmer)",
    ),
)
def c08(spark, sf_dir):
    """A motif whose second and fifth column count jointly, as the sequences' 6-mers pair them, and its best hits."""
    from ..operators import cluster

    rows = cluster.dependence(kmers.kmers_only(sequences(spark, sf_dir), 6).withColumnRenamed("kmer", "site"), [1, 4], 7).collect()
    motif = MOTIFS[0].with_groups({(1, 4): {r["word"]: r["p"] for r in rows}})
    found = scan.scan(sequences(spark, sf_dir), [motif], None, best_only=True)
    return found.groupBy("motif").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.lit(motif.parameters()).alias("parameters"))


@query("c11_column_learning")
def c11(spark, sf_dir):
    """Clusters of embedding rows, and how well a forest that has seen three quarters of the rows finds the clusters of the others."""
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    rows = kept(learn.column_clusters(rows, "embedding"))
    held = F.crc32(F.col("vec_id").cast("string")) % 4 == 0
    model = learn.train(rows.where(~held), "embedding", "cluster")
    return learn.predict(model, rows.where(held), "embedding").groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("cluster")).alias("n_right"))


@query(
    "c14_sub_motif",
    f"WITH {motif_values('lib', LIBRARY)}, tops AS (SELECT motif, width, col, {_TOP} AS b FROM lib) SELECT motif, string_agg(b, '' ORDER BY col) FILTER (col >= 1 AND col < width - 1) AS core, string_agg(b, '' ORDER BY md5('12345678:' || motif || ':' || col)) AS shuffled FROM tops GROUP BY motif",
)
def c14(spark, sf_dir):
    return spark.createDataFrame([(m.name, m.sub(1, len(m) - 1).best(), m.shuffled().best()) for m in LIBRARY], "motif string, core string, shuffled string")
