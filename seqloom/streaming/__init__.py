"""K-mer counts over a stream of sequences: the one aggregation of this engine that grows with its input alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kmers


def counts(stream: DataFrame, k: int, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(kmer, n) of a streaming or batch table of sequences; with a time column, for each window, and rows later than ``late``
    are left out. The state is 4**k rows, or as many for each open window."""
    if time is None:
        return kmers.kmers_only(stream, k).groupBy("kmer").agg(F.count("*").alias("n"))
    rows = kmers.explode(stream.withWatermark(time, late).withColumn("seq_id", F.lit(0)), k, time)
    return rows.groupBy(F.window(time, window), "kmer").agg(F.count("*").alias("n"))
