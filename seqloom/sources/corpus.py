"""Sequences from a documents table: the letters A, C, G and T of each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to all cores by some columns, if they are scanned in half as many tasks as there are cores or fewer.

    That is so for small files alone; a table of a cluster's size has more tasks than cores and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if 2 * rows._jdf.rdd().getNumPartitions() > cores else rows.repartition(cores, F.xxhash64(*keys))


def letters(text) -> Column:
    """A, C, G and T of a text in upper case; runs of other signs are removed at once."""
    return F.regexp_replace(F.upper(text), "[^ACGT]+", "")


def sequences(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    """(seq_id, seq, weight): whole texts with all other letters removed, if ``least`` letters are left."""
    rows = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    # a filter isn't moved below an explosion, so the letters are picked once for the column and the filter
    rows = rows.select(F.col("doc_id").alias("seq_id"), F.explode(F.array(letters("text"))).alias("seq"), F.col("n_chars").cast("double").alias("weight"))
    return rows.where(F.length("seq") >= least)


#: The same for the SQL that queries are compared with.
SQL = "seqs AS (SELECT * FROM (SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq, CAST(n_chars AS DOUBLE) AS weight FROM documents) WHERE length(seq) >= 10)"
