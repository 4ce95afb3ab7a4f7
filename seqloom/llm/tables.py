"""Small things that the queries share: reading a table, the folder that all executors share, labels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import dealt

#: Rows of an Arrow batch, unless the session says otherwise than Spark's 10,000: a batch holds whole texts.
BATCH_ROWS = 500
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Gives Arrow batches fewer rows, so that a worker's memory is bounded by a few texts."""
    if spark.conf.get(_SETTING) == "10000":
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; documents in a file or two are dealt to all cores, since each is worked on for long."""
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows, "doc_id", "text") if name == "documents" else rows


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, a local master, as in tests, gets a local folder; a
    cluster, whose executors wouldn't see it, is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="seqloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: Bytes that may be broadcast; larger sides are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def fitting(df: DataFrame, width: int = 16) -> DataFrame:
    """df with a broadcast hint if its rows, counted now, take no more than ``BROADCAST_BYTES`` at ``width`` bytes each.

    Larger sides are hashed, so that the other side's long rows aren't sorted.
    """
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df.hint("shuffle_hash")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus)


def label_sample(labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled ids that aren't held out, by the order of a hash of the id.

    Repeated rows of an id count once, with their largest label. ``bound`` is the documented limit of what a model is
    fitted on, so the result may be broadcast.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != held))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


#: UTF-8 bytes of the texts that a model is fitted on, at most.
FIT_BYTES = 48 << 20


def sample_texts(documents: DataFrame, chosen: DataFrame, most: int = FIT_BYTES) -> DataFrame:
    """(doc_id, label, text) of a label sample: one row for each id, the least text of repeated ones, so that the sample's
    bound holds however often an id is repeated. The ids are broadcast.

    Texts are whole; in the order of a hash of the id they are taken while their bytes are at most ``most`` together, and one
    that goes beyond that is passed over.
    """
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = written(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
    sizes = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, over = 0, []
    for r in sizes:
        if total + r["size"] <= most:
            total += r["size"]
        else:
            over.append(r["doc_id"])
    return rows.where(~F.col("doc_id").isin(over)) if over else rows
