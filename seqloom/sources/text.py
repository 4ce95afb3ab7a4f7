"""Text readers: FASTA, intensities, weights, matrices, peaks, answers, predicted sites.

Files are split into records or lines by Spark, so a reader is a plan like any other. Rows are numbered in the order of the file
by the place of their record, which a text source alone doesn't give: a reader numbers rows within one file by Spark's own
generated order and adds up the counts of the partitions before, so files are read whole and in order, and never on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordered


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(row, value) of the lines, or records, of a text file in order."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    raw = reader.text(path).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = raw.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each partition
    rows = raw.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return rows.select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("row"), "value")


def fasta(spark: SparkSession, path: str, *, drop_last: bool = False, limit: int | None = None) -> DataFrame:
    """(seq_id, name, seq): upper case, N removed, then - read as N. drop_last: without the last record, as older programs read.

    limit: records up to this number and that one, as older programs count.
    """
    records = lines(spark, path, "\n>").where(F.trim("value") != "")
    head = F.regexp_replace(F.split("value", "\r?\n", 2)[0], "^>", "")
    body = F.regexp_replace(F.coalesce(F.get(F.split("value", "\r?\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    out = records.select(F.col("row").alias("seq_id"), F.trim(head).alias("name"), F.translate(F.regexp_replace(F.upper(body), "N", ""), "-", "N").alias("seq"))
    if drop_last:
        out = out.crossJoin(F.broadcast(out.agg(F.max("seq_id").alias("_last")))).where("seq_id < _last").drop("_last")
    return out if limit is None else out.where(F.col("seq_id") <= limit)


def intensities(spark: SparkSession, path: str, *, limit: int | None = None, trim: int = 35) -> DataFrame:
    """(seq_id, seq, weight) of lines ``intensity<blank>sequence``: N removed, cut to ``trim`` letters, weights of mean 1."""
    parts = F.split(F.trim("value"), r"[\t ]+")
    rows = lines(spark, path).where(F.trim("value") != "")
    rows = rows.select(F.col("row").alias("seq_id"), F.substring(F.regexp_replace(F.upper(parts[1]), "N", ""), 1, trim).alias("seq"), (parts[0].cast("double") / 10000).alias("w"))
    rows = rows if limit is None else rows.where(F.col("seq_id") < limit)
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("w").alias("_mean")))).select("seq_id", "seq", (F.col("w") / F.col("_mean")).alias("weight"))


def weights(spark: SparkSession, path: str, sequences: DataFrame) -> DataFrame:
    """(seq_id, weight): the number after the last colon of each token, in order; sequences without one get the last weight."""
    split = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = lines(spark, path).select("row", split.alias("tokens")).where(F.size("tokens") > 0)
    rows = ordered.running_sums(rows.withColumn("n", F.size("tokens").cast("long")), "row", ["n"])
    tokens = rows.select("before_n", F.posexplode("tokens").alias("i", "token"))
    found = tokens.select((F.col("before_n") + F.col("i")).cast("long").alias("seq_id"), F.regexp_extract("token", r"([0-9.eE+-]+)$", 1).try_cast("double").alias("weight"))
    last = found.agg(F.max_by("weight", "seq_id").alias("_last"))
    return sequences.select("seq_id").join(found, "seq_id", "left").crossJoin(F.broadcast(last)).select("seq_id", F.coalesce("weight", "_last").alias("weight"))


def matrix(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(seq_id, values): delimited numbers, a row for each sequence."""
    return lines(spark, path).where(F.trim("value") != "").select(F.col("row").alias("seq_id"), F.transform(F.split("value", separator), lambda x: F.trim(x).try_cast("double")).alias("values"))


def prior(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(seq_id, pos, logp) of a matrix whose rows are a sequence's number and the log prior of each of its places."""
    rows = matrix(spark, path, separator).select(F.get("values", F.lit(0)).cast("long").alias("id"), F.slice(F.col("values"), F.lit(2), F.size("values")).alias("logs"))
    return rows.select(F.col("id").alias("seq_id"), F.posexplode("logs").alias("pos", "logp")).where("logp IS NOT NULL")


def with_prior(hits: DataFrame, logs: DataFrame) -> DataFrame:
    """hits with the log prior of their place added to the score; places without one keep their score."""
    rows = hits.join(logs, ["seq_id", "pos"], "left")
    return rows.withColumn("score", F.col("score") + F.coalesce("logp", F.lit(0.0))).drop("logp")


def signal_bins(signal: DataFrame, resolution: int) -> DataFrame:
    """(seq_id, bin, total) of a signal matrix."""
    cells = signal.select("seq_id", F.posexplode("values").alias("i", "v"))
    return cells.groupBy("seq_id", F.floor(F.col("i") / resolution).cast("int").alias("bin")).agg(F.sum("v").alias("total"))


def peaks(spark: SparkSession, path: str) -> DataFrame:
    """(peak, chrom, coords) of whitespace-separated lines; numbers that don't parse are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(F.trim("value") != "")
    return rows.select(F.col("row").alias("peak"), parts[0].alias("chrom"), F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.try_cast("long")), lambda x: x.isNotNull()).alias("coords"))


def flanking(peak_rows: DataFrame, width: int) -> DataFrame:
    """(peak, side, chrom, coords): each peak moved by three widths to the right, and to the left if all stays positive."""
    moved = lambda d: F.transform("coords", lambda x: x + d)
    right = peak_rows.select("peak", F.lit("right").alias("side"), "chrom", moved(3 * width).alias("coords"))
    left = peak_rows.select("peak", F.lit("left").alias("side"), "chrom", moved(-3 * width).alias("coords")).where(F.forall("coords", lambda x: x > 0))
    return left.unionByName(right)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, pos): the last two tab-separated fields of each line."""
    parts = F.split(F.rtrim("value"), "\t")
    return lines(spark, path).where(F.size(parts) >= 2).select(F.try_element_at(parts, F.lit(-2)).try_cast("long").alias("seq_id"), F.try_element_at(parts, F.lit(-1)).try_cast("long").alias("pos")).where("seq_id IS NOT NULL AND pos IS NOT NULL")


def amino_acids(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, aa, probs, protein) of lines ``column residues p,p,p,p [protein]``: training rows for a column predictor."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(F.size(parts) >= 3)
    probs = F.transform(F.split(parts[2], ","), lambda x: x.try_cast("double"))
    return rows.select("row", parts[0].try_cast("int").alias("col"), parts[1].alias("aa"), probs.alias("probs"), F.get(parts, F.lit(3)).alias("protein")).where((F.size("probs") == 4) & F.forall("probs", lambda x: x.isNotNull()))


def residues(rows: DataFrame, size: int) -> DataFrame:
    """rows with ``features``: one number for each of the first ``size`` residues and each of the 20 amino acids, 1 where they meet."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    cells = [F.when(F.substring("aa", i + 1, 1) == c, 1.0).otherwise(0.0) for i in range(size) for c in letters]
    return rows.withColumn("features", F.array(*cells))


#: Patterns of lines that give a predicted site: groups of the sequence and the position.
SITE_PATTERNS = {
    "csv": r"^\s*(\S+?)\s*,\s*(-?\d+)\s*$",
    "tab": r"^(?:[^\t]*\t)*([^\t]+)\t(-?\d+)\s*$",
    "colon": r"^\s*(\S+):\s*(-?\d+)\b",
    "bracket": r"^\s*\S+\s+\[(\S+)\s+(-?\d+)\]",
}


#: The reports of motif tools by the suffix of their files. A pattern found anywhere in a line, and its groups of the
#: sequence, the strand (0: the tool gives none) and the position.
TOOL_PATTERNS = {
    "out": (r">SEQ_(\d+)\s([b,f])(\d+)\s([A,C,G,T]+)", 1, 2, 3),
    "mds_out": (r">(\S+)\s\w+\s[\w+\s]*([b,f])(\d+)\s([A,C,G,T]+)", 1, 2, 3),
    "bpout": (r">SEQ_(\d+)\s\w+\s[\w+\s]*([r,f])(\d+)\s\S+\s([A,C,G,T]+)", 1, 2, 3),
    "annspec_out": (r"\w+\s+\S+\s+\S+\s+(\d+)\s+([A,C,G,T]+)\s+\S+\s+>SEQ_(\d+)", 3, 0, 1),
    "wee": (r"(\d+)\s+([+,-])\s+([\[,\],A,C,G,T]+)\s+(\d+)\s+\(", 1, 2, 4),
    "txt": (r"(\S+)\s+(\d+)\s+\d+\.\d+e", 1, 0, 2),
    "meme_out": (r"(\S+)\s+([+,-])\s+(\d+)\s+\d+\.\d+e", 1, 2, 3),
}


def predicted_sites(spark: SparkSession, path: str, tool: str | None = None, *, length: int = 200) -> DataFrame:
    """(list_id, seq, pos): lines that match the tool's pattern; a new list starts where matches resume after other lines.

    tool: a key of ``TOOL_PATTERNS`` or ``SITE_PATTERNS``; the file's suffix if it isn't given. Tools of ``TOOL_PATTERNS`` also
    give ``reverse``; their positions on the reverse strand are counted from the end and become ``length`` less the position,
    where ``length`` is that of the sequences. ``SEQ_`` before a number isn't part of seq.
    """
    tool = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1] if tool is None else tool
    if tool not in TOOL_PATTERNS and tool not in SITE_PATTERNS:
        raise ValueError(f"no pattern of predicted sites is known by the name {tool}")
    pattern, seq, strand, pos = TOOL_PATTERNS[tool] if tool in TOOL_PATTERNS else (SITE_PATTERNS[tool], 1, 0, 2)
    rows = lines(spark, path).select("row", "value", F.col("value").rlike(pattern).alias("ok")).where("ok")
    before = rows.select((F.col("row") + 1).alias("row"), F.lit(False).alias("start"))
    rows = rows.join(before, "row", "left").withColumn("start", F.coalesce("start", F.lit(True)).cast("long"))
    rows = ordered.running_sums(rows, "row", ["start"]).withColumn("list_id", (F.col("before_start") + F.col("start") - 1).cast("int"))
    group = lambda i: F.regexp_extract("value", pattern, i)
    if tool in SITE_PATTERNS:
        return rows.select("list_id", group(seq).alias("seq"), group(pos).cast("long").alias("pos"))
    reverse = group(strand).isin("r", "b", "-") if strand else F.lit(False)
    place = group(pos).cast("long")
    return rows.select("list_id", F.regexp_replace(group(seq), r"^SEQ_(\d+)$", "$1").alias("seq"), F.when(reverse, length - place).otherwise(place).alias("pos"), reverse.alias("reverse"))


def name_index(sequences: DataFrame, size: int = 24) -> DataFrame:
    """(key, seq_id): the first letters of names, the first sequence of equal ones."""
    return sequences.groupBy(F.substring("name", 1, size).alias("key")).agg(F.min("seq_id").alias("seq_id"))


def clean(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), "[^ACGT]+", "")
