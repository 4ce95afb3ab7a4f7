"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass over all training texts: each task adds up its (language, bucket) counts, and Spark sums them. Every
language is learned. The matrix of log probabilities is made and broadcast in blocks of ``BLOCK`` languages, in the order of
their names, so neither the driver nor a worker holds more than a block of it; the driver gets the names and a block's sums,
never a text. Scoring adds up, in numpy, the rows of a text's n-grams. One block is one pass and no shuffle; of several, each is
a pass over the texts, and a text's best language and its probability are put together from the blocks' results.

A text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn from or an
empty table. Rows with a null language aren't learned from. Of equally likely languages the first by name wins. Repeated rows
get equal results. Texts are read whole, however long, in chunks. Only doc_id, text and lang are looked at, whatever other
columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flattext as ft
from .tables import remainder, table, written

BITS = 13
ORDERS = (1, 2, 3)
#: Languages of a block of the matrix: it bounds a broadcast (2**13 x 512 floats, 16 MB), not the languages.
BLOCK = 512

_FOLD = ft.LOWER.copy()
_FOLD[~ft.LETTER] = 0x20


def grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of letters of a chunk; runs of other characters count as one space."""
    folded = _FOLD[data]
    space = folded == 0x20
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(keep)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))
    text = folded[at].astype(np.uint32)
    code, out_rows, out = np.zeros_like(text), [], []
    for n in range(1, max(ORDERS) + 1):
        if len(text) < n:
            break
        code = text.copy() if n == 1 else (code[:-1] << np.uint32(8)) | text[n - 1 :]
        if n in ORDERS:
            inside = rows[: len(code)] == rows[n - 1 :]
            h = (code + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out_rows.append(rows[: len(code)][inside])
            out.append((h >> np.uint32(32 - bits))[inside])
    return (np.concatenate(out_rows), np.concatenate(out).astype(np.int64)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter; only texts with none of A-Z and a-z are looked at as Unicode."""
    out = np.zeros(len(texts), dtype=bool)
    plain = ft.byte_class((0x41, 0x5A), (0x61, 0x7A))
    for low, high, data, offsets in ft.chunks(texts):
        total = np.concatenate([[0], np.cumsum(plain[data])])
        out[low:high] = total[offsets[1:]] > total[offsets[:-1]]
        for i in np.flatnonzero(~out[low:high]):
            if offsets[i + 1] > offsets[i]:
                out[low + i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    return out


@dataclass
class Model:
    """Log priors and log probabilities of a block of languages."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int = BITS

    def best(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the number of the likeliest language, its log likelihood, and the log of the sum of all likelihoods."""
        top, most, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        for low, high, data, offsets in ft.chunks(texts):
            rows, buckets = grams(data, offsets, self.bits)
            n = high - low
            z = self.log_prior + np.stack([ft.sums(column[buckets], rows, n) for column in self.log_prob], axis=1)
            top[low:high] = z.argmax(axis=1)
            most[low:high] = z.max(axis=1)
            total[low:high] = most[low:high] + np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
        return top, most, total

    def predict(self, texts: pa.Array, known: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Names and probabilities, of this block's languages alone."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        known = known & has_letter(texts)
        top, most, total = self.best(texts)
        return np.where(known, np.array(self.languages, dtype=object)[top], "und").tolist(), np.where(known, np.exp(most - total), 0.0)


@dataclass
class Learned:
    """Counts (lang, c) of all languages, each one's rows at bucket -1, and the first names of the blocks."""

    counts: DataFrame
    names: list[str]
    rows: int
    bits: int
    block: int

    def __len__(self) -> int:
        return -(-len(self.names) // self.block)

    def model(self, i: int) -> Model:
        """The i-th block of languages."""
        names = self.names[i * self.block : (i + 1) * self.block]
        if not names:
            return Model([], np.zeros(0), np.zeros((0, 1)), self.bits)
        at = {name: k for k, name in enumerate(names)}
        matrix, rows = np.zeros((len(names), 1 << self.bits)), np.zeros(len(names))
        for r in self.counts.where(F.col("lang").between(names[0], names[-1])).collect():
            bucket, n = np.array([x[0] for x in r["c"]]), np.array([x[1] for x in r["c"]], dtype=np.float64)
            matrix[at[r["lang"]], bucket[bucket >= 0]] = n[bucket >= 0]
            rows[at[r["lang"]]] = n[bucket < 0][0]
        matrix += 0.5
        matrix /= matrix.sum(axis=1, keepdims=True)
        return Model(names, np.log((rows + 1) / (self.rows + len(self.names))), np.log(matrix).astype(np.float32), self.bits)


def train(documents: DataFrame, *, bits: int = BITS, block: int = BLOCK) -> Learned:
    """Counts over all rows of ``documents`` with columns text and lang."""
    size = 1 << bits

    def counted(batches):
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            texts = ft.filled(batch.column("text"))
            coded = batch.column("lang").dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for low, high, data, offsets in ft.chunks(texts):
                rows, buckets = grams(data, offsets, bits)
                here, own = np.unique(codes[low:high], return_inverse=True)
                found = np.bincount(own[rows] * size + buckets, minlength=len(here) * size).reshape(-1, size)
                for k, i in enumerate(here):
                    total[names[i]] = total.get(names[i], 0) + found[k]
                    seen[names[i]] = seen.get(names[i], 0) + int((own == k).sum())
            if len(total) >= 64:
                yield from emitted(total, seen)
                total, seen = {}, {}
        yield from emitted(total, seen)

    def emitted(total, seen):
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], seen[name]).astype(np.int64))], ["lang", "bucket", "n"]
            )

    learn = documents.where(F.col("lang").isNotNull()).select("text", "lang")
    counts = learn.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = written(counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")), "languages")
    listed = packed.select("lang", F.col("c")[0]["n"].alias("n")).collect()
    # by bytes, which is how Spark compares strings
    return Learned(packed, sorted((r["lang"] for r in listed), key=lambda x: x.encode()), sum(r["n"] for r in listed), bits, block)


def predict(documents: DataFrame, learned: Learned) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``documents``."""
    context = documents.sparkSession.sparkContext
    if len(learned) <= 1:
        shared = context.broadcast(learned.model(0))

        def scored(batches):
            own = shared.value
            for batch in batches:
                names, best = own.predict(ft.filled(batch.column("text")), np.asarray(batch.column("text").is_valid()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

        return documents.select("doc_id", "text").mapInArrow(scored, "doc_id long, lang_pred string, score double")

    rows = written(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")

    def part(i: int) -> DataFrame:
        """(row, z, lang, total) of the texts with a letter, by the i-th block."""
        shared = context.broadcast(learned.model(i))

        def scored(batches):
            own = shared.value
            for batch in batches:
                texts = ft.filled(batch.column("text"))
                known = np.flatnonzero(np.asarray(batch.column("text").is_valid()) & has_letter(texts))
                top, most, total = own.best(texts)
                names = pa.array(np.array(own.languages, dtype=object)[top[known]].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(known)), pa.array(most[known]), names, pa.array(total[known])], ["row", "z", "lang", "total"])

        return rows.select("row", "text").mapInArrow(scored, "row long, z double, lang string, total double")

    parts = [written(part(i), "block") for i in range(len(learned))]
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    # the likeliest, then the first by name; the sum of likelihoods relative to the likeliest, lest it vanishes
    best = every.groupBy("row").agg(F.min(F.struct((-F.col("z")).alias("z"), "lang")).alias("b"), F.collect_list("total").alias("totals"))
    score = F.expr("1 / aggregate(totals, 0D, (a, t) -> a + exp(t + b.z))")
    return rows.select("row", "doc_id").join(best, "row", "left").select("doc_id", F.coalesce("b.lang", F.lit("und")).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
