"""Draws that are hashes of what they draw for: the same in every run, on any number of machines, and in SQL."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import BASES
from .motifs import Motif

_SCALE = float(1 << 48)


def uniform(seed: int, key) -> Column:
    """A number in [0, 1) from the md5 of the seed and a key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string") if isinstance(key, Column) else F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / _SCALE


def draw(seed: int, key) -> float:
    """The same number for a key on the driver."""
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) / _SCALE


def weighted_draws(rows: DataFrame, weight: str, n: int, seed: int, order: str) -> DataFrame:
    """(draw, order): n draws with replacement in proportion to a weight, by binary search in the running sum.

    The running sum is made in buckets; each draw then finds its row by an equality join on cells of the total.
    """
    from ..functions import ordered

    summed = ordered.running_sums(rows.select(order, weight), order, [weight])
    total = summed.agg(F.sum(weight)).first()[0] or 0.0
    cells = max(1, n)
    size = total / cells if total else 1.0
    spans = summed.where(F.col(weight) > 0).withColumn("stop", F.col(f"before_{weight}") + F.col(weight))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"before_{weight}") / size), F.floor(F.col("stop") / size))))
    draws = rows.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), (uniform(seed, F.col("id")) * total).alias("at"))
    draws = draws.withColumn("cell", F.floor(F.col("at") / size))
    met = draws.join(spans, "cell").where((F.col("at") >= F.col(f"before_{weight}")) & (F.col("at") < F.col("stop")))
    return met.groupBy("draw").agg(F.min(order).alias(order))


def inverse(draws: DataFrame, u: Column, weights: DataFrame, kind: str, weight: str) -> DataFrame:
    """draws with the kind whose share of the running sum of the weights, in the order of the kinds, holds the number u in [0, 1).

    The weights are one broadcast row of two lists, for a few thousand kinds; ``weighted_draws`` is for more.
    """
    rows = weights.where(F.col(weight) > 0).agg(F.sort_array(F.collect_list(F.struct(F.col(kind).alias("k"), F.col(weight).cast("double").alias("w")))).alias("_l"))
    upto = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.aggregate(F.slice("_l", F.lit(1), i), F.lit(0.0), lambda s, x: s + x["w"]))
    rows = rows.where(F.size("_l") > 0).select(F.transform("_l", lambda x: x["k"]).alias("_kinds"), upto.alias("_upto"))
    at = F.size(F.filter("_upto", lambda c: c <= u * F.element_at("_upto", -1)))
    return draws.crossJoin(F.broadcast(rows)).withColumn(kind, F.get("_kinds", F.least(at, F.size("_kinds") - 1))).drop("_kinds", "_upto")


#: A prime that products of two numbers below it leave 64 bits enough for.
_PRIME = (1 << 31) - 1


def _numbers(seed: int, keys: np.ndarray, i: int) -> np.ndarray:
    """Numbers in [0, 1) for the i-th draw of each key: quadratic maps modulo a prime, so that whole columns are drawn at once."""
    x = (keys % _PRIME * 48271 + i * 69621 + seed * 16807 + 1) % _PRIME
    for factor, shift in ((950706376, 12345), (1226874159, 7), (62089911, 99991)):
        x = (x * x + x * factor % _PRIME + shift) % _PRIME
    return x / _PRIME


def markov_sequences(lengths: DataFrame, model: dict[str, float], order: int, seed: int) -> DataFrame:
    """(seq_id, seq): a random sequence for each (seq_id, len) from a background model; a letter is drawn by a hash of the seed,
    the id and the place. A batch's sequences grow together, a letter of each at a time."""
    tables = []  # of contexts of 0, 1, ... order letters, by number: the running sums of the next letter
    for k in range(order + 1):
        names = ["".join(p) for p in itertools.product(BASES, repeat=k)]
        tables.append(np.cumsum([[model.get(n + b, 0.25) for b in BASES] for n in names], axis=1))
    letters = np.frombuffer(BASES.encode(), dtype=np.uint8)

    def made(batches):
        for batch in batches:
            ids = batch.column("seq_id").to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.nan_to_num(batch.column("len").to_numpy(zero_copy_only=False)).astype(np.int64)
            falling = np.argsort(-size, kind="stable")
            ids_f, size_f = ids[falling], size[falling]
            start = np.cumsum(size) - size
            body, context = np.zeros(int(size.sum()), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
            for i in range(int(size_f[0]) if len(size_f) else 0):
                n = int(np.searchsorted(-size_f, -i, side="left"))  # sequences longer than i
                table = tables[min(i, order)][context[:n]]
                base = np.minimum((_numbers(seed, ids_f[:n], i)[:, None] * table[:, 3:] >= table[:, :3]).sum(axis=1), 3)
                body[start[falling[:n]] + i] = letters[base]
                context[:n] = (context[:n] * 4 + base) % 4 ** min(i + 1, order)
            raw = body.tobytes().decode()
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array([raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)], pa.string())], ["seq_id", "seq"])

    return lengths.select("seq_id", "len").mapInArrow(made, "seq_id long, seq string")


def running(motif: Motif) -> np.ndarray:
    """The running sums of each column's probabilities, A to T."""
    return np.cumsum(motif.weights / motif.weights.sum(axis=1, keepdims=True), axis=1)


def random_site(motif: Motif, seed: int, key) -> str:
    """A string drawn from a motif, a column by a hash of the seed, the key and its number."""
    return "".join(BASES[min(int((draw(seed, f"{key}:{c}") >= row[:3]).sum()), 3)] for c, row in enumerate(running(motif)))


def planted(sequences: DataFrame, motif: Motif, share: float, seed: int, both_strands: bool = True) -> DataFrame:
    """(seq_id, seq, site, pos, reverse): a site drawn from the motif written in lower case into a share of the sequences.

    Sequences without a site, or shorter than it, have nulls there. All draws are hashes of the seed, the id and what is drawn.
    """
    u = lambda what: uniform(seed, F.concat_ws(":", F.col("seq_id").cast("string"), F.lit(str(what))))

    def site(m: Motif) -> Column:
        columns = [F.when(u(c) < row[0], "A").when(u(c) < row[1], "C").when(u(c) < row[2], "G").otherwise("T") for c, row in enumerate(running(m).tolist())]
        return F.concat(*columns)

    back = (u("strand") < 0.5) if both_strands else F.lit(False)
    chosen = (F.length("seq") >= len(motif)) & (u("share") < share)
    at = F.floor(u("pos") * (F.length("seq") - len(motif) + 1)).cast("int")
    rows = sequences.select("seq_id", "seq", F.when(chosen, at).alias("pos"), F.when(chosen, back).alias("reverse"))
    rows = rows.withColumn("site", F.when(F.col("reverse"), site(motif.reverse_complement())).when(~F.col("reverse"), site(motif)))
    text = F.when(F.col("pos").isNull(), F.col("seq")).otherwise(F.concat(F.substring(F.col("seq"), F.lit(1), F.col("pos")), F.lower("site"), F.substring(F.col("seq"), F.col("pos") + len(motif) + 1, F.length("seq"))))
    return rows.select("seq_id", text.alias("seq"), "site", "pos", "reverse")
