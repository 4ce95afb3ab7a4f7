"""The corpus pipeline: documents in, encoded documents out. Each stage reads what the one before it wrote.

Stages take (spark, docs, sf_dir) and work on every row of docs; all but the last return the columns of documents. None can
be expressed in SQL as a whole, so there is no oracle; tests compare the stages with brute force.

All stages: a null text counts as empty and stays null where texts stay; texts are read whole, however long; repeated rows are
treated alike; an empty table gives an empty one; columns beside doc_id and text pass through, whatever their names, up to the
last stage. Rows are told apart by doc_id and text, so different texts under one id, or under none, are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontam, pii, piece, simhash, toxicity
from seqloom.llm.tables import small_batches, table, written

#: Documents with this calibrated probability of being toxic, or a larger one, are rejected.
TOXIC = 0.3

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts with a window that is toxic with a probability of ``TOXIC`` or more. The network is fitted on the labelled rows
    among docs; without any, nothing is rejected."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, net, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each group that SimHash fingerprints link, the one with the least doc_id; of rows with equal ids and
    fingerprints, one."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that hold a passage of the benchmark, words replaced or not. Without a benchmark, nothing is rejected."""
    return decontam.without_passages(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets and counts n_chars anew; keeps all rows."""
    small_batches(spark)
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, the hash of what they decode to, and lang and source; keeps all rows. A null or
    empty text is the end id alone."""
    small_batches(spark)
    return piece.encode(docs, None, "lang", "source")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
