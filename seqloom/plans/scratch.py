"""Folders for what a query writes and reads again: under the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir. Where that is unset, a local master gets a local folder; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="seqloom-")
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """rows as a table in such a folder, for plans that read them more than once."""
    path = folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
