"""Writers: motif files, background models, positions, score matrices, masked sequences. Tables are written by Spark; a motif
file is a few kilobytes of text and is written as one part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.motifs import Motif


def motif_text(motifs: list[Motif], trim: bool = True) -> str:
    """TRANSFAC-like blocks; columns of little information are trimmed from the ends of motifs over 8 columns."""
    out = []
    for m in motifs:
        own = m.trimmed() if trim else m
        out.append(f"DE\t{m.name}\t{own.consensus()}\t{m.score:.6f}\t{m.sites:g}")
        out.append("PO\tA\tC\tG\tT")
        out += [f"{i}\t" + "\t".join(f"{w:.6f}" for w in row) + f"\t{c}" for i, (row, c) in enumerate(zip(own.weights, own.consensus(), strict=True))]
        for columns, table in m.extra.get("groups", {}).items():
            out.append("XXD")
            out.append("-".join(map(str, columns)) + ":" + "\t".join(f"{k}|{p:.6f}" for k, p in table.items()))
        out.append("XXX" if m.extra.get("groups") else "XX")
    return "\n".join(out) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_motifs(spark: SparkSession, motifs: list[Motif], path: str, *, by_score: bool = False) -> None:
    """by_score: the best first; equal scores by name, none is lost."""
    rows = sorted(motifs, key=lambda m: (-m.score, m.name)) if by_score else motifs
    write_text(spark, motif_text(rows), path)


def write_background(model: DataFrame, path: str, order: int) -> None:
    head = model.sparkSession.createDataFrame([(f"# order {order}", 0, "")], "value string, k int, prefix string")
    rows = model.select(F.concat_ws(" ", "prefix", F.format_string("%.12f", "p")).alias("value"), F.length("prefix").alias("k"), "prefix")
    head.union(rows).orderBy("k", "prefix").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_positions(hits: DataFrame, sequences: DataFrame, width: int, path: str) -> None:
    """Tab-separated with a header: match site, sequence, position, score, strand."""
    rows = hits.join(sequences.select("seq_id", "seq"), "seq_id")
    site = F.substring(F.col("seq"), F.col("pos") + 1, F.lit(width))
    out = rows.select(site.alias("site"), F.col("seq_id").cast("string").alias("seq"), "pos", "score", F.when(F.col("reverse"), "-").otherwise("+").alias("strand"))
    out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_fasta(sequences: DataFrame, path: str) -> None:
    name = F.col("name") if "name" in sequences.columns else F.col("seq_id").cast("string")
    sequences.select(F.concat(F.lit(">"), name, F.lit("\n"), F.coalesce("seq", F.lit("")))).write.mode("overwrite").text(path)


def write_answers(planted: DataFrame, motif: str, path: str) -> None:
    """motif, site, sequence and position of planted sites, tab-separated."""
    rows = planted.where("pos IS NOT NULL").select(F.lit(motif).alias("motif"), "site", "seq_id", "pos")
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Scores, profiles and evaluations as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def write_hot_sites(hits: DataFrame, sequences: DataFrame, flank: int, path: str) -> None:
    """FASTA of the windows around hits (seq_id, motif, pos, width), cut at the ends of their sequences; a name is
    motif:sequence:position."""
    rows = hits.join(sequences.select("seq_id", "seq"), "seq_id")
    start = F.greatest(F.col("pos") - flank, F.lit(0))
    window = F.substring(F.col("seq"), start + 1, F.col("pos") + F.col("width") + flank - start)
    write_fasta(rows.select(F.concat_ws(":", "motif", F.col("seq_id").cast("string"), F.col("pos").cast("string")).alias("name"), window.alias("seq")), path)


def write_matches(hits: DataFrame, sequences: DataFrame, path: str) -> None:
    """motif, matched string and how often, tab-separated, of hits (seq_id, motif, pos, width)."""
    rows = hits.join(sequences.select("seq_id", "seq"), "seq_id")
    counts = rows.groupBy("motif", F.substring(F.col("seq"), F.col("pos") + 1, F.col("width")).alias("site")).agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").option("sep", "\t").csv(path)


def write_places(hits: DataFrame, path: str) -> None:
    """A folder for each motif with lines of sequence, position, strand and score, tab-separated."""
    rows = hits.select("motif", "seq_id", "pos", F.when(F.col("reverse"), "-").otherwise("+").alias("strand"), "score")
    rows.write.mode("overwrite").partitionBy("motif").option("sep", "\t").csv(path)


def write_evaluation(rows: DataFrame, path: str) -> None:
    """Lines of motif, AUC, and numbers of positives and negatives, tab-separated with a header, the best motif first."""
    out = rows.orderBy(F.desc("auc"), "motif").select("motif", F.format_string("%.6f", "auc").alias("auc"), "n_pos", "n_neg")
    out.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)  # a row for each motif
