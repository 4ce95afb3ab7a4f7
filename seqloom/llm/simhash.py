"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has 64 bits; each is the majority of that bit over the XXH64 values of the text's word shingles. Two
fingerprints that differ in at most 2 bits, cut into 2 segments, differ by at most one bit in one of the segments. So each
distinct fingerprint is indexed under its 2 whole segments and its 64 segment variants with one wildcard bit, rows with equal
keys meet, and the whole fingerprints are verified.

Equal fingerprints are one row of the index, so exact copies cost nothing. Two rows of a key are verified as a pair. Where
three or more meet, the other segment is indexed in turn, under itself and its 32 variants with one bit turned over: those
under one such key differ from it by one bit each, which bounds a group by 66 rows and makes a star of it exact, so no pairs
of a group are listed and nothing is capped.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. A null doc_id is never
the smallest id of a component unless all its ids are null. Repeated rows come back as often as they came. An empty table gives
an empty result. Texts are read whole, however long. Only doc_id and text are looked at, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flattext as ft
from .components import components
from .tables import fitting, free_name, table, written

SHINGLE = 3
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one UTF-8 text, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)])
    raw = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    n, ones = len(raw), np.zeros(64, dtype=np.int64)
    for low in range(0, n, 1 << 15):
        ones += np.unpackbits(raw[low : low + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row, from its whole text."""

    def made(batches):
        for batch in batches:
            texts = ft.filled(batch.column("text"))
            found = []
            for low, high, data, offsets in ft.chunks(texts):
                body = data.tobytes()
                found += [fingerprint(body[a:b], shingle, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(made, "doc_id long, fp long")


#: Rows of a key that are verified pair by pair at most; larger keys are split exactly, see ``_dense``.
PAIRWISE = 64

_OTHER = "CASE WHEN i < 32 OR i = 64 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END"


def signatures(classes: DataFrame) -> DataFrame:
    """(key, bit, fp): each fingerprint under its 64 one-wildcard segment variants (i < 64) and its 2 whole segments."""
    rows = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i"))
    rows = rows.withColumn("seg", F.expr("CASE WHEN i < 32 OR i = 64 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END"))
    rows = rows.withColumn("bit", F.expr("CASE WHEN i < 64 THEN cast(shiftrightunsigned(seg, i % 32) & 1 AS int) END"))
    masked = F.expr("CASE WHEN i < 64 THEN seg & ~shiftleft(1L, i % 32) ELSE seg END")
    return rows.select((F.expr("shiftleft(cast(i AS bigint), 32)").bitwiseOR(masked)).alias("key"), "bit", "fp", F.expr(_OTHER).alias("other"))


def _dense(rows: DataFrame) -> DataFrame:
    """Edges within keys of many rows: the other segment is indexed under itself and its variants with one bit turned over.

    Under one (key, z), fingerprints of an equal wildcard bit differ by at most 2 bits in all, so they are linked to the
    least of them. One whose other segment is z differs by at most one bit there from all the rest, so it also links the
    two halves of the wildcard bit.
    """
    near = rows.withColumn("z", F.explode(F.expr("concat(array(other), transform(sequence(0, 31), j -> other ^ shiftleft(1L, j)))")))
    least = lambda bit: F.min(F.when(F.coalesce("bit", F.lit(0)) == bit, F.col("fp")))
    grouped = near.groupBy("key", "z").agg(
        F.collect_set(F.struct(F.coalesce("bit", F.lit(0)).alias("bit"), "fp")).alias("members"), least(0).alias("m0"), least(1).alias("m1"), F.max(F.col("other") == F.col("z")).alias("centre")
    )
    star = grouped.select(F.explode("members").alias("r"), "m0", "m1").select(F.col("r.fp").alias("a"), F.when(F.col("r.bit") == 0, F.col("m0")).otherwise(F.col("m1")).alias("b"))
    across = grouped.where(F.col("centre") & F.col("m0").isNotNull() & F.col("m1").isNotNull()).select(F.col("m0").alias("a"), F.col("m1").alias("b"))
    return star.where("a <> b").union(across)


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links, pairs within 2 bits; an edge may stand for a way over several links.

    classes: distinct values in column fp.
    """
    # each row becomes 66, so the rows are dealt to as many tasks as a shuffle has, however few bytes they are
    index = signatures(classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")))
    keys = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.min("bit").alias("lo"), F.max("bit").alias("hi"))
    # a wildcard key whose rows agree on the wildcard bit adds nothing to the whole segment's key
    keys = written(keys.where((F.col("n") >= 2) & (F.col("lo").isNull() | (F.col("lo") < F.col("hi")))), "keys")
    close = "bit_count(a ^ b) <= 2"
    pairs = keys.where((F.col("n") == 2) & F.expr(close)).select("a", "b")
    shared = index.join(keys.where("n > 2").select("key", "n"), "key")
    few = shared.where(F.col("n") <= PAIRWISE)
    several = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where(F.expr(f"a < b AND {close}")).select("a", "b")
    return pairs.union(several).union(_dense(shared.where(F.col("n") > PAIRWISE))).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component, component_id) of every row: its fingerprint, the group's smallest fingerprint and doc_id."""
    return grouped(written(fingerprints(documents), "fingerprints"))


def grouped(prints: DataFrame) -> DataFrame:
    """The same of a table of (doc_id, fp), which is read several times."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(links(classes.select("fp")))
    named = classes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "classes")
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints.join(named.select("fp", "component").join(ids, "component"), "fp").select("doc_id", "fp", "component", "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` for each group: one with the group's smallest doc_id.

    Rows are told apart by id and fingerprint, so one id on rows of several groups stays once in each; of rows with equal ids and
    fingerprints, and of a group without any id, the row with the least hash of its text stays. The ids to go are broadcast if
    their counted size allows it, so texts aren't shuffled then; only texts of null and repeated ids are read again.
    """
    found = written(near_duplicates(documents).select("doc_id", "fp", "component"), "groups")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("k"))
    kept = written(least.select("k.doc_id", "k.fp"), "kept")
    several = written(found.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1 OR doc_id IS NULL").select("doc_id"), "several")
    gone = found.where(F.col("doc_id").isNotNull()).join(kept, ["doc_id", "fp"], "left_anti").select("doc_id")
    gone = written(gone.union(several.where(F.col("doc_id").isNotNull())).distinct(), "gone")
    rows = documents.where(F.col("doc_id").isNotNull()).join(fitting(gone), "doc_id", "left_anti").select(documents.columns)
    if not several.limit(1).count():
        return rows
    fp, own, kept_fp = (free_name(documents, n) for n in ("own_fp", "own_id", "kept_fp"))
    again = documents.join(fitting(several.withColumnRenamed("doc_id", own)), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    again = again.mapInArrow(_with_fingerprint(documents.columns, fp), documents.select("*", F.lit(0).cast("long").alias(fp)).schema)
    chosen = kept.select(F.col("doc_id").alias(own), F.col("fp").alias(kept_fp))
    again = again.join(fitting(chosen, 24), F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(fp) == F.col(kept_fp)), "left_semi")
    first = F.min_by(F.struct(*documents.columns), F.struct(F.xxhash64("text"), "text")).alias("r")
    return rows.union(again.groupBy(F.col("doc_id").alias(own), F.col(fp)).agg(first).select("r.*"))


def _with_fingerprint(names: list[str], fp: str):
    def made(batches):
        for batch in batches:
            texts = ft.filled(batch.column("text"))
            found = [fingerprint((texts[i].as_py()).encode()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.int64())], [*names, fp])

    return made


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
