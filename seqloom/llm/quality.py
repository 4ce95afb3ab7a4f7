"""Quality classifier: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

Tokens are runs of letters and digits and runs of other signs. Features are the tokens, the pairs of neighbours and the
pairs of their shapes (case, digits, signs), hashed to ``2**bits`` weights; a word that repeats its neighbour makes the
same pair whatever the word is. A feature's value is its share of the text's features, so a score is one gather and one
sum for each text: a sparse dot product, without sorting.

Nulls and empty texts have no features and get the intercept's score. Repeated rows get equal scores. With no usable
label, or labels of one kind only, every score is that share of positive labels (0.5 with none). An empty table gives an empty
result. Texts are read whole, however long, in chunks. Only doc_id and text are looked at, and doc_id and quality of the
labels, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flattext as ft
from .tables import label_sample, remainder, sample_texts, table

#: Labelled rows that a model is fitted on, at most; they are taken in the order of a hash of the id.
FIT_ROWS = 4000
BITS = 18
SCALE = 24.0

_SIGN = ~(ft.WORD | ft.SPACE)
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[ft.LETTER] = 0
_KIND[0x41:0x5B] = 1
_KIND[ft.DIGIT] = 2


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature occurrence in a chunk of texts, rows ascending within each kind."""
    ws, we = ft.runs(ft.WORD[data], offsets)
    ss, se = ft.runs(_SIGN[data], offsets)
    starts, ends = np.concatenate([ws, ss]), np.concatenate([we, se])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    rows = ft.owner(starts, offsets)
    words = ft.hash_runs(data, starts, ends)
    if not len(words):
        return rows, words.astype(np.int64)
    first, last = _KIND[data[starts]], _KIND[data[ends - 1]]
    shape = (first.astype(np.uint64) * np.uint64(4) + last) * np.uint64(16) + np.minimum(ends - starts, 15).astype(np.uint64)
    same = rows[1:] == rows[:-1]
    pair = ft.mix(words[:-1] * np.uint64(3) + words[1:])
    pair[words[1:] == words[:-1]] = np.uint64(0x5DEECE66D)
    shapes = ft.mix(shape[:-1] * np.uint64(1024) + shape[1:] + np.uint64(0xABCD1234))
    shift = np.uint64(64 - bits)
    spin = np.uint64(0x9E3779B97F4A7C15)
    all_rows = np.concatenate([rows, rows[1:][same], rows[1:][same]])
    buckets = np.concatenate([words, pair[same], shapes[same]]) * spin >> shift
    return all_rows, buckets.astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for low, high, data, offsets in ft.chunks(texts):
            rows, buckets = features(data, offsets, self.bits)
            n = high - low
            count = np.maximum(np.bincount(rows, minlength=n), 1)
            z = self.bias + SCALE * ft.sums(self.weights[buckets], rows, n) / count
            out[low:high] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """Follow-the-regularised-leader (proximal): one pass over the rows per epoch, a learning rate for each weight."""
    n, positive = len(labels), float(np.sum(labels))
    if not n or positive in (0.0, float(n)):
        share = min(max(positive / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << bits, dtype=np.float32), float(np.log(share / (1 - share))), bits)
    z, g2 = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    intercept = 1 << bits

    def leader(at: np.ndarray) -> np.ndarray:
        pulled = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, pulled / ((beta + np.sqrt(g2[at])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(n):
            at, x = vectors[i]
            at, x = np.append(at, intercept), np.append(x, 1.0)
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha
            z[at] += g - sigma * w
            g2[at] += g * g
    w = leader(np.arange((1 << bits) + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def vectors_of(texts: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vectors of texts: distinct buckets and their values."""
    out = []
    for low, high, data, offsets in ft.chunks(texts):
        rows, buckets = features(data, offsets, bits)
        key, count = np.unique(rows.astype(np.int64) << bits | buckets, return_counts=True)
        row, bucket = key >> bits, key & ((1 << bits) - 1)
        cut = np.searchsorted(row, np.arange(high - low + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            out.append((bucket[a:b].astype(np.int32), (SCALE * count[a:b] / max(1, count[a:b].sum())).astype(np.float32)))
    return out


def train(documents: DataFrame, labels: DataFrame, *, bound: int = FIT_ROWS, bits: int = BITS) -> Model:
    """Fits on at most ``bound`` labelled rows of ``tables.FIT_BYTES`` at most together; executors make the sparse vectors, the
    driver only gets those."""
    chosen = label_sample(labels, "quality", 3, 1, bound)
    rows = sample_texts(documents, chosen)

    def sparse(batches):
        for batch in batches:
            made = vectors_of(ft.filled(batch.column("text")), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))],
                ["doc_id", "label", "at", "x"],
            )

    got = rows.mapInArrow(sparse, "doc_id long, label int, at array<int>, x array<float>").toArrow().sort_by("doc_id")
    at, x = got["at"].combine_chunks(), got["x"].combine_chunks()
    cut = at.offsets.to_numpy()
    flat_at, flat_x = at.flatten().to_numpy(), x.flatten().to_numpy()
    vectors = [(flat_at[a - cut[0] : b - cut[0]], flat_x[a - cut[0] : b - cut[0]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return fit_ftrl(vectors, got["label"].to_numpy(), bits)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``documents``, from its whole text. The broadcast is ``2**bits`` floats."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.scores(ft.filled(batch.column("text"))))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
