"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A batch of changes inserts or replaces documents (``put``) or removes them (``drop``). Its texts are counted, what the same
documents counted for before is looked up, and the difference, signed and summed by source, language and tokenizer version, is
written. Totals are the sums of all committed deltas, so they never need the texts again.

Under one root, on any file system that Spark writes to: ``state/<attempt>`` what each document of a batch counts for now,
``deltas/<attempt>`` the batch's difference, ``commits/<number>`` the batch's id and attempt. A batch takes effect when its
commit file comes into being: it is written under another name and renamed, which fails if the number is taken. Until then
the batch's files are ignored, so a job may die anywhere and be run again, and readers never see half a commit; files that
aren't whole commits are passed over, and their numbers aren't used again. A batch whose id is committed is not applied a second
time, and of two writers with the same number the later one starts over from the other's state. As with the checkpoints of
streams, the file system's rename must be atomic.

After every ``compact`` commits the state, the totals and the ids of all batches so far are written as a snapshot, which takes
effect in the same way. Reading needs the latest snapshot and the commits behind it, so neither the plans nor the files that the
driver opens grow with the number of batches. A job that dies while it makes a snapshot leaves the totals as they are.

All rows of an id in a batch together are that document's state: repeated rows count as often as they come, and a later batch
replaces them all. A null id is one document. Null and empty texts count as documents with no tokens; texts are counted whole,
however long. Null sources or languages are groups of their own. Unknown operations are an error. An empty batch is committed
and changes nothing. Totals that return to no documents aren't listed. Other columns of a batch are not looked at.
"""

from __future__ import annotations

import base64
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flattext as ft
from .tables import shared_dir, table

DIMENSIONS = ("source", "lang", "tokenizer", "version")
TOKENIZER, VERSION = "byte_bpe_50k", "1"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with column tokens, the number of tokens of the whole text, in place of text."""
    path = path or default_ranks()
    names = [c for c in rows.columns if c != "text"]
    schema = rows.select(*names, F.lit(0).cast("long").alias("tokens")).schema

    def count(batches):
        own = _encoding(path)
        for batch in batches:
            texts = ft.filled(batch.column("text"))
            n = np.fromiter((len(own.encode_ordinary(texts[i].as_py())) for i in range(len(texts))), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n)], [*names, "tokens"])

    return rows.mapInArrow(count, schema)


_STATE = "doc_id long, source string, lang string, tokenizer string, version string, docs long, tokens long"
_DELTA = "source string, lang string, tokenizer string, version string, docs long, tokens long"


class Rollup:
    """Totals under a root folder. tokenizer and version name what ``ranks`` counts, and are dimensions of the totals."""

    def __init__(self, spark: SparkSession, root: str, tokenizer: str = TOKENIZER, version: str = VERSION, ranks: str | None = None, compact: int = 16):
        self.spark, self.root, self.tokenizer, self.version, self.ranks, self.compact = spark, root.rstrip("/"), tokenizer, version, ranks, compact
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        """The numbers of the files of a folder, ascending."""
        path = self._path(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Makes a file with its whole text, unless there is one of that name."""
        target, draft = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target):
            self._fs.delete(draft, False)
            return False
        return self._renamed(draft, target)

    def _renamed(self, draft, target) -> bool:
        if self._fs.getScheme() == "file":  # its rename would replace a file
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
            return True
        jvm = self.spark._jvm
        mode = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        mode[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, mode)
        except Exception:
            if self._fs.exists(target):
                self._fs.delete(draft, False)
                return False
            raise
        return True

    def _snapshot(self) -> tuple[int, str | None]:
        """The number of the last commit in the latest snapshot, and its folder."""
        numbers = self._numbers("snapshots")
        return (numbers[-1], f"{self.root}/compact/{self._read(f'snapshots/{numbers[-1]:09d}')}") if numbers else (0, None)

    def _view(self) -> tuple[tuple[int, str | None], list[tuple[int, str, str]], int]:
        """The latest snapshot, the (number, batch id, attempt) of the commits behind it in order, and the next free number."""
        snapshot, out = self._snapshot(), []
        numbers = self._numbers("commits")
        for n in numbers:
            if n > snapshot[0] and "\n" in (text := self._read(f"commits/{n:09d}")):
                attempt, batch = text.split("\n", 1)
                out.append((n, batch, attempt))
        return snapshot, out, max([snapshot[0], *numbers]) + 1

    def _commit(self, number: int, batch: str, attempt: str) -> bool:
        """Whether this writer's commit is the one with this number."""
        return self._create(f"commits/{number:09d}", f"{attempt}\n{batch}")

    def committed(self, batch: str) -> bool:
        """Whether the batch has taken effect."""
        (_, folder), commits, _ = self._view()
        if any(b == batch for _, b, _ in commits):
            return True
        return bool(folder) and self.spark.read.schema("batch string").parquet(f"{folder}/batches").where(F.col("batch") == batch).limit(1).count() > 0

    def _state(self, snapshot, commits) -> DataFrame | None:
        """What each document counted for; the row with the largest number is the latest."""
        number, folder = snapshot
        parts = [(number, f"{folder}/state")] if folder else []
        parts += [(n, f"{self.root}/state/{a}") for n, _, a in commits]
        out = None
        for n, path in parts:
            one = self.spark.read.schema(_STATE).parquet(path).withColumn("number", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out

    def _latest(self, state: DataFrame) -> DataFrame:
        last = state.groupBy(F.col("doc_id").alias("id")).agg(F.max("number").alias("last"))
        return state.join(last, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("number") == F.col("last"))).drop("id", "last")

    def snapshot(self) -> bool:
        """Writes state, totals and batch ids up to the last commit as one table each. False if another writer did."""
        before, commits, _ = self._view()
        if not commits:
            return False
        attempt = uuid.uuid4().hex
        folder = f"{self.root}/compact/{attempt}"
        latest = self._latest(self._state(before, commits)).where("docs > 0")
        latest.select("doc_id", *DIMENSIONS, "docs", "tokens").write.parquet(f"{folder}/state")
        self._deltas(before, commits).write.parquet(f"{folder}/totals")
        batches = self.spark.createDataFrame([(b,) for _, b, _ in commits], "batch string")
        if before[1]:
            batches = batches.union(self.spark.read.schema("batch string").parquet(f"{before[1]}/batches"))
        batches.write.parquet(f"{folder}/batches")
        return self._create(f"snapshots/{commits[-1][0]:09d}", attempt)

    def _deltas(self, snapshot, commits) -> DataFrame:
        paths = ([f"{snapshot[1]}/totals"] if snapshot[1] else []) + [f"{self.root}/deltas/{a}" for _, _, a in commits]
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        return rows.groupBy(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of (doc_id, op, source, lang, text), op being put or drop. False if it was committed already."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        op = F.when(F.col("op").isin("put", "drop"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))))
        rows = counted(changes.select("doc_id", op.alias("op"), "source", "lang", F.when(F.col("op") == "put", F.col("text")).alias("text")), self.ranks)
        put = F.col("op") == "put"
        now = rows.groupBy("doc_id", F.when(put, F.col("source")).alias("source"), F.when(put, F.col("lang")).alias("lang")).agg(
            F.sum(put.cast("long")).alias("docs"), F.sum(F.when(put, F.col("tokens")).otherwise(0)).alias("tokens")
        )
        now = now.select("doc_id", "source", "lang", F.lit(self.tokenizer).alias("tokenizer"), F.lit(self.version).alias("version"), "docs", "tokens")
        now.write.parquet(f"{self.root}/state/{attempt}")
        now = self.spark.read.parquet(f"{self.root}/state/{attempt}")
        while True:
            snapshot, commits, number = self._view()
            signed = now.select(*DIMENSIONS, "docs", "tokens")
            if (before := self._state(snapshot, commits)) is not None:
                ids = now.select(F.col("doc_id").alias("id")).distinct()
                before = self._latest(before.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"))
                signed = signed.union(before.select(*DIMENSIONS, -F.col("docs"), -F.col("tokens")))
            delta = signed.groupBy(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
            delta.write.mode("overwrite").parquet(f"{self.root}/deltas/{attempt}")
            if self._commit(number, batch, attempt):
                if len(commits) + 1 >= self.compact:
                    self.snapshot()
                return True
            if self.committed(batch):
                return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, version, n_docs, n_tokens) by all committed deltas."""
        return self._deltas(*self._view()[:2]).withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the documents table after a load of all rows, its repetition, a revision of some texts, which makes them longer
    and moves them to another source, the removal of half of these, and the return of all to what they were."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, shared_dir(spark, "token-counts"))
    some = documents.where("doc_id % 20 = 0")
    revised = some.select("doc_id", F.concat(F.lit("revised "), F.coalesce("source", F.lit(""))).alias("source"), "lang", F.concat(F.coalesce("text", F.lit("")), F.lit(" as revised")).alias("text"))
    rollup.apply("load", documents.withColumn("op", F.lit("put")))
    rollup.apply("load", documents.withColumn("op", F.lit("put")))
    rollup.apply("revision", revised.withColumn("op", F.lit("put")))
    rollup.apply("removal", some.where("doc_id % 40 = 0").withColumn("op", F.lit("drop")))
    rollup.apply("return", some.withColumn("op", F.lit("put")))
    return rollup.totals()
