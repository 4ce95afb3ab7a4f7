"""K-mers: explosion, counts, neighbourhoods, over-representation. K-mer rows are as many as bases, so all of these project
early and aggregate before they shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .scan import numbered


def _placed(sequences: DataFrame, k: int, keep, compat: bool) -> DataFrame:
    """(seq_id, kept columns, pos, kmer): windows are cut from bytes, which finds a place at once, where a string is walked
    through from its start. The letters are ASCII, so bytes and letters are the same."""
    rows = sequences.select("seq_id", *keep, F.col("seq").cast("binary").alias("_b"))
    last = F.length("_b") - k - (1 if compat else 0)
    rows = rows.where(last >= 0).select("seq_id", *keep, "_b", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return rows.select("seq_id", *keep, "pos", F.substring(F.col("_b"), F.col("pos") + 1, F.lit(k)).cast("string").alias("kmer"))


def explode(sequences: DataFrame, k: int, *keep: str, compat: bool = False) -> DataFrame:
    """(seq_id, kept columns, pos, kmer) of every window; ``compat`` leaves out the last one of each sequence."""
    return _placed(sequences, k, keep, compat)


def kmers_only(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer) of every window: what counting needs, without positions."""
    rows = sequences if "seq_id" in sequences.columns else sequences.withColumn("seq_id", F.lit(0))
    return _placed(rows, k, (), False).select("kmer")


def count(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer, n): counted in each task before the shuffle, which then has 4**k rows a task at most."""
    return kmers_only(sequences, k).groupBy("kmer").agg(F.count("*").alias("n"))


def postings(sequences: DataFrame, k: int, span: int = 256) -> DataFrame:
    """(kmer, block, places): an inverted index. places are (seq_id, pos) in order; a block holds the sequences of ``span``
    neighbouring ids, so that the list of a frequent k-mer has a bound and is dealt to many tasks."""
    rows = explode(sequences, k).select("kmer", F.floor(F.col("seq_id") / span).alias("block"), F.struct("seq_id", "pos").alias("place"))
    return rows.groupBy("kmer", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))


def base_frequencies(sequences: DataFrame, reach: int = 150) -> DataFrame:
    """(base, centre, background): shares of the bases less than ``reach`` from the middle of their sequences, and elsewhere."""
    low = F.greatest(F.floor(F.length("seq") / 2 - reach).cast("int") + 1, F.lit(0))
    high = F.least(F.ceil(F.length("seq") / 2 + reach).cast("int"), F.length("seq"))
    rows = sequences.select("seq", F.substring(F.col("seq"), low + 1, high - low).alias("inner"))
    n = lambda c, b: (F.length(c) - F.length(F.replace(F.col(c), F.lit(b)))).cast("long")
    sums = rows.agg(*(F.sum(n("inner", b)).alias(f"i{b}") for b in dna.BASES), *(F.sum(n("seq", b) - n("inner", b)).alias(f"o{b}") for b in dna.BASES))
    total = lambda s: sum((F.col(f"{s}{b}") for b in dna.BASES), F.lit(0))
    cells = F.array(*(F.struct(F.lit(b).alias("base"), F.try_divide(F.col(f"i{b}"), total("i")).alias("centre"), F.try_divide(F.col(f"o{b}"), total("o")).alias("background")) for b in dna.BASES))
    return sums.select(F.inline(cells))


#: Bytes of hashes that may be broadcast; more are joined by a shuffle, before which Spark's own Bloom filters apply.
BROADCAST_BYTES = 64 << 20


def sharing(sequences: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(seq_id) of the sequences with a k-mer that others have, compared by 64-bit hashes. Those of the others are counted, and
    broadcast if they fit."""
    theirs = explode(others, k).select(F.xxhash64("kmer").alias("h")).distinct()
    theirs = F.broadcast(theirs) if theirs.count() * 16 <= BROADCAST_BYTES else theirs
    return explode(sequences, k).select("seq_id", F.xxhash64("kmer").alias("h")).join(theirs, "h", "left_semi").select("seq_id").distinct()


def entropy(sequences: DataFrame, k: int) -> DataFrame:
    """(seq_id, n, bits): windows of each sequence and the entropy of its k-mers; at most 4**k rows a sequence are shuffled."""
    counts = explode(sequences, k).groupBy("seq_id", "kmer").agg(F.count("*").alias("c"))
    sums = counts.groupBy("seq_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.select("seq_id", "n", (F.log2("n") - F.col("s") / F.col("n")).alias("bits"))


def weighted_presence(sequences: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """(kmer, n_seqs, mean_weight): each sequence credits a k-mer, and its reverse complement if ``both_strands``, once.

    Each task adds up its own sequences in numpy and emits 4**k rows at most; k is at most 12. A null weight counts as 0.
    """
    size, schema = 4**k, "code long, n long, w double"

    def counted(batches):
        n, total = np.zeros(size, dtype=np.int64), np.zeros(size)
        for batch in batches:
            codes, offsets = numbered(batch.column("seq"))
            weights = np.nan_to_num(batch.column("weight").to_numpy(zero_copy_only=False).astype(float))
            low = 0
            while low < len(weights):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 20), side="right")) - 1)
                part, cut = codes[offsets[low] : offsets[high]].astype(np.int64), offsets[low : high + 1] - offsets[low]
                if len(part) >= k:
                    width = len(part) - k + 1
                    forward, backward, bad = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64), np.zeros(width, dtype=bool)
                    for i in range(k):
                        c = part[i : i + width]
                        forward, backward = forward * 4 + c, backward + (3 - c) * 4**i
                        bad |= c > 3
                    row = np.searchsorted(cut, np.arange(width), side="right") - 1
                    good = ~bad & (np.arange(width) + k <= cut[row + 1])
                    key = row[good] * size + forward[good]
                    if both_strands:
                        key = np.concatenate([key, row[good] * size + backward[good]])
                    key = np.unique(key)
                    n += np.bincount(key % size, minlength=size)
                    total += np.bincount(key % size, weights=weights[low:high][key // size], minlength=size)
                low = high
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(total[at])], ["code", "n", "w"])

    rows = sequences.select("seq", F.col("weight").cast("double").alias("weight")).mapInArrow(counted, schema)
    sums = rows.groupBy("code").agg(F.sum("n").alias("n_seqs"), F.sum("w").alias("w"))
    return sums.select(dna.from_code("code", k).alias("kmer"), "n_seqs", (F.col("w") / F.col("n_seqs")).alias("mean_weight"))


def neighbourhood(counts: DataFrame, k: int) -> DataFrame:
    """(kmer, n): of each k-mer, the counts of all k-mers that differ at one of the places before the last two, and its own for each such place."""
    variants = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: F.transform(F.array(*map(F.lit, dna.BASES)), lambda b: F.concat(F.substring("kmer", F.lit(1), i - 1), b, F.substring(F.col("kmer"), i + 1, F.lit(k))))))
    return counts.select(F.explode(variants).alias("kmer"), "n").groupBy("kmer").agg(F.sum("n").alias("n"))


def masked_counts(counts: DataFrame, k: int) -> DataFrame:
    """(pattern, n): counts rolled up over every way of masking three neighbouring places by N."""
    masks = F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: F.concat(F.substring("kmer", F.lit(1), i - 1), F.lit("NNN"), F.substring(F.col("kmer"), i + 3, F.lit(k))))
    return counts.select(F.explode(masks).alias("pattern"), "n").groupBy("pattern").agg(F.sum("n").alias("n"))


def with_background(counts: DataFrame, model: DataFrame, k: int, order: int) -> DataFrame:
    """counts with p: the k-mer's probability under a Markov model (prefix, p) with contexts of ``order`` letters.

    The model has at most 4 ** (order + 1) rows for each prefix length, so it is broadcast as one map.
    """
    as_map = model.select(F.map_from_entries(F.collect_list(F.struct("prefix", "p"))).alias("model"))
    terms = [F.element_at("model", F.substring("kmer", max(1, i + 1 - order), min(i + 1, order + 1))) for i in range(k)]
    p = terms[0]
    for t in terms[1:]:
        p = p * t
    return counts.crossJoin(F.broadcast(as_map)).withColumn("p", p).drop("model")


def represented(counts: DataFrame, model: DataFrame, k: int, order: int) -> DataFrame:
    """The k-mers that are more frequent than expected: (kmer, n, expected, odds), odds being the ratio."""
    total = counts.agg(F.sum("n").alias("total"))
    scored = with_background(counts, model, k, order).crossJoin(F.broadcast(total))
    scored = scored.withColumn("expected", F.col("p") * F.col("total")).withColumn("odds", F.col("n") / F.col("expected"))
    return scored.where("n > expected").select("kmer", "n", F.round("expected", 6).alias("expected"), F.round("odds", 6).alias("odds"))


def over_represented(counts: DataFrame, model: DataFrame, k: int, order: int, limit: int) -> DataFrame:
    """Those with the greatest ratio."""
    return represented(counts, model, k, order).orderBy(F.desc("odds"), "kmer").limit(limit)
