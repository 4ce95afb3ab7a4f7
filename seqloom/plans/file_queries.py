"""Queries that write files in the formats that are read, and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kmers, learn, metrics
from ..operators.motifs import Motif
from ..sources import motif_files, sinks, text
from ..sources.corpus import letters, sequences, table
from . import workflows
from .evaluation_queries import library_sql
from .model_queries import _CORE, _WIDE, LIBRARY, motif_values
from .registry import over_seqs, query, windows
from .scan_queries import _AUC, HITS, LABELLED, MOTIFS, SCORED, best, hits, labelled, located
from .scratch import folder, kept


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), letters("text").alias("seq"))


_ITEM_SEQS = "items AS (SELECT item_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)"


@query("s02_first_records", f"WITH {_ITEM_SEQS} SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM items WHERE seq <> '' ORDER BY seq_id LIMIT 11")
def s02(spark, sf_dir):
    """The first records of a FASTA file, up to number 10 and that one."""
    path = folder(spark)
    rows = items(spark, sf_dir).where("seq <> ''").orderBy("seq_id").coalesce(1)  # one file, as the limit is on its order
    sinks.write_fasta(rows, path)
    return text.fasta(spark, path, limit=10).select("name", "seq")


@query(
    "s03_capped_controls",
    over_seqs(f"SELECT seq_id FROM seqs WHERE seq_id NOT IN (SELECT seq_id FROM kmers20 JOIN (SELECT substr(seq, p + 1, 20) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - 19)) AS p FROM items)) USING (kmer)) ORDER BY seq_id LIMIT (SELECT greatest(1000, 2 * count(*)) + 1 FROM benchmark)", windows(20), _ITEM_SEQS),
)
def s03_capped(spark, sf_dir):
    """Controls without a 20-mer of the benchmark's, the first ones, as many as older programs keep."""
    return workflows.clean_controls(sequences(spark, sf_dir), items(spark, sf_dir), 20).select("seq_id")


@query(
    "s05_posting_index",
    over_seqs("SELECT kmer, seq_id // 256 AS block, count(*) AS n, CAST(min(seq_id) AS BIGINT) AS first_seq, CAST(arg_min(pos, (seq_id, pos)) AS BIGINT) AS first_pos, CAST(sum(pos) AS BIGINT) AS sum_pos FROM kmers4 GROUP BY 1, 2", windows(4)),
)
def s05(spark, sf_dir):
    rows = kmers.postings(sequences(spark, sf_dir), 4)
    total = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["pos"])
    first = F.col("places")[0]
    return rows.select("kmer", "block", F.size("places").cast("long").alias("n"), first["seq_id"].alias("first_seq"), first["pos"].cast("long").alias("first_pos"), total.alias("sum_pos"))


@query(
    "s06_centre_frequencies",
    over_seqs(
        "SELECT base, round(count(*) FILTER (inside) / sum(count(*) FILTER (inside)) OVER (), 9) AS centre, round(count(*) FILTER (NOT inside) / sum(count(*) FILTER (NOT inside)) OVER (), 9) AS background FROM (SELECT base, abs(place - len / 2) < 150 AS inside FROM (SELECT length(seq) AS len, unnest(string_split(seq, '')) AS base, unnest(range(0, length(seq))) AS place FROM seqs)) GROUP BY base"
    ),
)
def s06(spark, sf_dir):
    return kmers.base_frequencies(sequences(spark, sf_dir)).select("base", F.round("centre", 9).alias("centre"), F.round("background", 9).alias("background"))


@query("s30_base_frequencies", over_seqs("SELECT base, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM (SELECT unnest(string_split(seq, '')) AS base FROM seqs) GROUP BY base"))
def s30(spark, sf_dir):
    rows = kmers.count(sequences(spark, sf_dir), 1)
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(F.col("kmer").alias("base"), F.round(F.col("n") / F.col("total"), 9).alias("p"))


@query("s07_weights", "SELECT item_id AS seq_id, CAST(CASE WHEN item_id < 25 THEN length(text) ELSE (SELECT length(text) FROM benchmark WHERE item_id = 24) END AS DOUBLE) AS weight FROM benchmark")
def s07(spark, sf_dir):
    """A weight for each of the first 25 names; the others get the last one."""
    path = folder(spark)
    rows = table(spark, sf_dir, "benchmark").where("item_id < 25").select("item_id", F.concat(F.lit("item"), "item_id", F.lit(":"), F.length("text")).alias("token"))
    lines = rows.groupBy(F.floor(F.col("item_id") / 4).alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "token"))), lambda x: x["token"]), " ").alias("value"))
    lines.orderBy("line").select("value").coalesce(1).write.text(path)
    return text.weights(spark, path, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id")))


def _number(x) -> str:
    return f"{float(x):.6f}"


def _by_column(m: Motif, numbered: bool, separator: str = " ") -> str:
    return "".join((f"{i}{separator}" if numbered else "") + separator.join(map(_number, row)) + "\n" for i, row in enumerate(m.weights, 1))


def _by_base(m: Motif, head) -> str:
    return "".join(head(b) + " ".join(map(_number, m.weights[:, k])) + "\n" for k, b in enumerate("ACGT"))


#: Layouts: the file's name, the text of a motif, and whether the file has names (else motifs are numbered).
LAYOUTS = {
    "s11_transfac": ("x.dat", lambda m: f"NA {m.name}\nP0 A C G T\n{_by_column(m, True)}XX\n", True),
    "s13_jaspar": ("x.jaspar", lambda m: f">{m.name}\n" + _by_base(m, lambda b: f"{b} [ ").replace("\n", " ]\n"), True),
    "s14_meme": ("x.meme", lambda m: f"MOTIF {m.name}\nletter-probability matrix: alength= 4 w= {len(m)} nsites= 20 E= 0\n{_by_column(m, False)}\n", True),
    "s15_chipmunk": ("chipmunk.txt", lambda m: "KDIC|1.5\n" + _by_base(m, lambda b: f"{b}|"), False),
    "s16_thetafinal": ("thetafinal.txt", lambda m: _by_base(m, lambda b: ""), False),
    "s17_zifnet": ("x.zifnet", lambda m: _by_base(m, lambda b: f"{m.name} "), True),
    "s18_uniprobe": ("x.unip", lambda m: f"{m.name}\n" + _by_base(m, lambda b: f"{b}: "), True),
    "s19_cisfinder": ("x.cisf", lambda m: f">{m.name}\n{_by_column(m, True)}", True),
    "s20_weeder": ("x.wee", lambda m: f"All Occurrences\n{_by_column(m, True)}\n", False),
    "s21_trawler": ("x.traw", lambda m: f">{m.name}\n{_by_column(m, False)}", True),
    "s22_comma_transfac": ("x.trans", lambda m: f"DE,{m.name},x\nPO,A,C,G,T\n{_by_column(m, True, ',')}XX\n", True),
    "s22_bars": ("x.admout", lambda m: f"PwmMotif({m.name}): score 1.5\n |{'|'.join(str(i) for i in range(len(m)))}|\n----\n" + "".join(f"{b}|{'|'.join(map(_number, m.weights[:, k]))}|\n" for k, b in enumerate("ACGT")) + "\n", True),
}


def _named(layout: str) -> list[Motif]:
    """The library under the names that a file of the layout gives its motifs."""
    return [Motif(f"PwmMotif({m.name})" if layout == "s22_bars" else m.name if LAYOUTS[layout][2] else f"motif{i}", m.weights) for i, m in enumerate(LIBRARY, 1)]


def _layout(name: str):
    @query(name, library_sql(_named(name), 4))
    def again(spark, sf_dir):
        file, text_of, _ = LAYOUTS[name]
        path = f"{folder(spark)}/{file}"
        sinks.write_text(spark, "".join(map(text_of, LIBRARY)), path)
        return motif_files.read_table(spark, path).select("motif", "col", "base", F.round("w", 4).alias("w"))

    return again


for _name in LAYOUTS:
    _layout(_name)


@query("s09_dispatched_formats", "SELECT * FROM (VALUES " + ", ".join(f"('{LAYOUTS[n][0]}', {len(LIBRARY)}::BIGINT, {sum(map(len, LIBRARY))}::BIGINT)" for n in LAYOUTS) + ") t(file, n_motifs, n_columns)")
def s09(spark, sf_dir):
    """All layouts, each read by the name of its file."""
    root, rows = folder(spark), None
    for file, text_of, _ in LAYOUTS.values():
        sinks.write_text(spark, "".join(map(text_of, LIBRARY)), f"{root}/{file}")
        found = motif_files.read_table(spark, f"{root}/{file}").select(F.lit(file).alias("file"), "motif", "col")
        rows = found if rows is None else rows.union(found)
    return rows.distinct().groupBy("file").agg(F.countDistinct("motif").alias("n_motifs"), F.count("*").alias("n_columns"))


_GROUPS = {(1, 4): {"AA": 0.5, "CG": 0.25, "N": 0.25}, (0, 2, 3): {"ACG": 0.125, "N": 0.875}}


@query("s12_joint_columns", "SELECT * FROM (VALUES " + ", ".join(f"('m1', '{'-'.join(map(str, c))}', '{w}', {p}::DOUBLE)" for c, words in _GROUPS.items() for w, p in words.items()) + ") t(motif, columns, word, p)")
def s12(spark, sf_dir):
    """Motifs with joint columns."""
    path = f"{folder(spark)}/x.dpwm"
    sinks.write_motifs(spark, [MOTIFS[0].with_groups(_GROUPS)], path)
    rows = [(m.name, "-".join(map(str, c)), w, p) for m in motif_files.read(spark, path) for c, words in m.extra["groups"].items() for w, p in words.items()]
    return spark.createDataFrame(rows, "motif string, columns string, word string, p double")


@query("s24_prior_matrix", "SELECT vec_id AS seq_id, CAST(i AS INTEGER) AS pos, round(v[i + 1], 6) AS logp FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def s24(spark, sf_dir):
    path = folder(spark)
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    values = F.transform("embedding", lambda x: F.format_string("%.6f", x.cast("double")))
    rows.select(F.concat_ws("\t", F.col("vec_id").cast("string"), F.array_join(values, "\t"))).write.text(path)
    return text.prior(spark, path).select("seq_id", "pos", F.round("logp", 6).alias("logp"))


@query("s26_predicted_sites", over_seqs("SELECT CAST(seq_id AS VARCHAR) AS seq, CASE WHEN reverse THEN 1000 - pos ELSE pos END AS pos, reverse FROM hits WHERE motif = 'm1'", *HITS))
def s26(spark, sf_dir):
    """Hits as a tool reports them, in sequences of 1000 letters, whose positions on the reverse strand count from the end."""
    path = f"{folder(spark)}/sites.bpout"
    place = F.concat(F.lit(">SEQ_"), F.col("seq_id"), F.lit(" len 1000 "), F.when(F.col("reverse"), "r").otherwise("f"), F.col("pos"), F.lit(" 0.5 ACGT"))
    hits(spark, sf_dir, "m1").select(place).write.text(path)
    return text.predicted_sites(spark, path, length=1000).select("seq", "pos", "reverse")


_AMINO = [(c, "ACDEFGHIKL"[c % 7 : c % 7 + 3], m.weights[c], m.name) for m in LIBRARY for c in range(len(m))]


@query("s28_residues", "SELECT * FROM (VALUES " + ", ".join(f"({c}, '{aa}', '{name}', {round(float(p[0]), 6)!r}::DOUBLE, {round(float(p[3]), 6)!r}::DOUBLE, 3.0::DOUBLE)" for c, aa, p, name in _AMINO) + ") t(col, aa, protein, a, t, n)")
def s28(spark, sf_dir):
    """Training lines of a column predictor, and their residues as numbers."""
    path = folder(spark)
    sinks.write_text(spark, "\n".join(f"{c} {aa} {','.join(map(_number, p))} {name}" for c, aa, p, name in _AMINO), path)
    rows = text.residues(text.amino_acids(spark, path), 3)
    return rows.select("col", "aa", "protein", F.col("probs")[0].alias("a"), F.col("probs")[3].alias("t"), F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("n"))


@query("k01_trimmed_file", f"WITH {motif_values('lib', _WIDE)}, ends AS (SELECT motif, width, {_CORE} FROM lib GROUP BY motif, width) SELECT motif, CAST(col - head AS INTEGER) AS col, round(a, 5) AS a FROM lib JOIN ends USING (motif, width) WHERE col >= head AND col < tail")
def k01(spark, sf_dir):
    """A motif file without the columns of few bits at the ends of long motifs."""
    path = f"{folder(spark)}/x.pwm"
    sinks.write_motifs(spark, _WIDE, path)
    return motif_files.read_table(spark, path).where("base = 'A'").select("motif", "col", F.round("w", 5).alias("a"))


@query("k02_joint_file", "SELECT * FROM (VALUES " + ", ".join(f"('{m.name}', {len(m)}, {19 if m.name == 'm1' else 3 * len(m)})" for m in MOTIFS) + ") t(motif, width, parameters)")
def k02(spark, sf_dir):
    """Motifs with and without joint columns in one file: widths and free numbers after reading."""
    words = {a + b: 0.1 for a, b in ("AA", "AC", "AG", "AT", "CA", "CC", "CG")} | {"N": 0.3}
    path, rows = folder(spark), []
    for m in (MOTIFS[0].with_groups({(1, 4): words}), *MOTIFS[1:]):
        sinks.write_motifs(spark, [m], f"{path}/{m.name}.dpwm")
        rows += [(x.name, len(x), x.parameters()) for x in motif_files.read(spark, f"{path}/{m.name}.dpwm")]
    return spark.createDataFrame(rows, "motif string, width int, parameters int")


_BY_WIDTH = sorted(LIBRARY, key=lambda m: (-len(m), m.name))


@query("k04_sorted_motif_file", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{m.name}', {len(m)}.0::DOUBLE)" for i, m in enumerate(_BY_WIDTH)) + ") t(place, motif, score)")
def k04(spark, sf_dir):
    """A motif file by falling score; equal scores stand by name and none is lost."""
    path = f"{folder(spark)}/raw.pwm"
    sinks.write_motifs(spark, [Motif(m.name, m.weights, float(len(m))) for m in LIBRARY], path, by_score=True)
    return spark.createDataFrame([(i, m.name, m.score) for i, m in enumerate(motif_files.read(spark, path))], "place int, motif string, score double")


_RANKED = "SELECT motif, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round(" + _AUC + ", 6) AS auc FROM (SELECT motif, label, rank() OVER (PARTITION BY motif ORDER BY score) + (count(*) OVER (PARTITION BY motif, score) - 1) / 2.0 AS r FROM labelled) GROUP BY motif"


def evaluated(spark, sf_dir):
    return kept(metrics.auc(kept(labelled(spark, sf_dir).select("motif", "score", "label")), "motif"))


@query("k06_evaluation_file", over_seqs(_RANKED, *LABELLED))
def k06(spark, sf_dir):
    path = folder(spark)
    sinks.write_evaluation(evaluated(spark, sf_dir), path)
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select("motif", F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), F.col("auc").cast("double").alias("auc"))


@query("k07_motifs_by_auc", over_seqs(f"SELECT motif, CAST(row_number() OVER (ORDER BY auc DESC, motif) - 1 AS INTEGER) AS place FROM ({_RANKED})", *LABELLED))
def k07(spark, sf_dir):
    """A motif file in the order of how well the motifs tell labels apart."""
    path, score = f"{folder(spark)}/sorted.pwm", {r["motif"]: round(r["auc"], 6) for r in evaluated(spark, sf_dir).collect()}
    sinks.write_motifs(spark, [Motif(m.name, m.weights, score.get(m.name, 0.0)) for m in MOTIFS], path, by_score=True)
    return spark.createDataFrame([(m.name, i) for i, m in enumerate(motif_files.read(spark, path))], "motif string, place int")


@query("k12_score_profiles", over_seqs("SELECT seq_id, motif, round(max(score), 6) AS score FROM scored GROUP BY ALL", *SCORED))
def k12(spark, sf_dir):
    path = folder(spark)
    sinks.write_table(best(spark, sf_dir).select("seq_id", "motif", "score"), path)
    return spark.read.parquet(path).select("seq_id", "motif", F.round("score", 6).alias("score"))


@query(
    "k13_hot_sites",
    over_seqs("SELECT motif || ':' || h.seq_id || ':' || pos AS name, substr(seq, greatest(pos - 10, 0) + 1, pos + width + 10 - greatest(pos - 10, 0)) AS seq FROM hits h JOIN seqs q ON q.seq_id = h.seq_id", *HITS),
)
def k13(spark, sf_dir):
    """FASTA of the windows around hits."""
    path = folder(spark)
    sinks.write_hot_sites(located(spark, sf_dir), sequences(spark, sf_dir), 10, path)
    return text.fasta(spark, path).select("name", "seq")


@query("k13_matches", over_seqs("SELECT motif, substr(seq, pos + 1, width) AS site, count(*) AS n FROM hits h JOIN seqs q ON q.seq_id = h.seq_id GROUP BY 1, 2", *HITS))
def k13_matches(spark, sf_dir):
    path = folder(spark)
    sinks.write_matches(located(spark, sf_dir), sequences(spark, sf_dir), path)
    return spark.read.schema("motif string, site string, n long").option("sep", "\t").csv(path)


@query("k14_place_files", over_seqs("SELECT motif, seq_id, CAST(pos AS INTEGER) AS pos, CASE WHEN reverse THEN '-' ELSE '+' END AS strand, round(score, 6) AS score FROM hits", *HITS))
def k14(spark, sf_dir):
    path = folder(spark)
    sinks.write_places(hits(spark, sf_dir), path)
    rows = spark.read.schema("seq_id long, pos int, strand string, score double, motif string").option("sep", "\t").csv(path)
    return rows.select("motif", "seq_id", "pos", "strand", F.round("score", 6).alias("score"))


@query("k16_saved_classifier", "SELECT count(*) AS n, count(*) AS n_same FROM embeddings WHERE embedding IS NOT NULL")
def k16(spark, sf_dir):
    """A forest that is written and read again predicts the same."""
    path = folder(spark)
    rows = kept(table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding", F.pmod("label", F.lit(4)).alias("label")))
    model = learn.train(rows, "embedding", "label", trees=5)
    learn.save(model, path)
    again = learn.predict(learn.load(path), learn.predict(model, rows, "embedding").withColumnRenamed("predicted", "first"), "embedding")
    return again.agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("predicted")).alias("n_same"))
