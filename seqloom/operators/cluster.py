"""Grouping motifs: greedy filters, hierarchical clustering, combinations, dependent columns; and similar sequences."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from . import kmers
from .motifs import Motif, divergence
from .scan import numbered, scores


def greedy_filter(order: list[str], overlap: dict[tuple[str, str], float], most: float, at_least: int | None = None) -> list[str]:
    """Names in order of merit, each kept if it overlaps no kept one by more than ``most``; while fewer than ``at_least``
    are kept and the limit is below 1, the limit grows by a fifth and the filter starts again."""
    while True:
        kept: list[str] = []
        for name in order:
            if all(max(overlap.get((name, k), 0.0), overlap.get((k, name), 0.0)) <= most for k in kept):
                kept.append(name)
        if at_least is None or len(kept) >= min(at_least, len(order)) or most >= 1:
            return kept
        most *= 1.2


def divergence_filter(motifs: list[Motif], overlap: dict[tuple[str, str], float], most_overlap: float, least_divergence: float) -> list[Motif]:
    """Motifs by falling score without those that overlap a better one too much or look like it."""
    kept: list[Motif] = []
    for m in sorted(motifs, key=lambda m: (-m.score, m.name)):
        if all(max(overlap.get((m.name, k.name), 0.0), overlap.get((k.name, m.name), 0.0)) <= most_overlap and divergence(m, k) >= least_divergence for k in kept):
            kept.append(m)
    return kept


#: Lance-Williams coefficients of each linkage: of the two merged clusters, of their distance, of the difference.
def _coefficients(linkage: str, a: int, b: int, c: int):
    return {
        "SINGLE": (0.5, 0.5, 0.0, -0.5),
        "COMPLETE": (0.5, 0.5, 0.0, 0.5),
        "UPGMA": (a / (a + b), b / (a + b), 0.0, 0.0),
        "WPGMA": (0.5, 0.5, 0.0, 0.0),
        "UPGMC": (a / (a + b), b / (a + b), -a * b / (a + b) ** 2, 0.0),
        "WPGMC": (0.5, 0.5, -0.25, 0.0),
        "WARD": ((a + c) / (a + b + c), (b + c) / (a + b + c), -c / (a + b + c), 0.0),
    }[linkage]


def hierarchical(distance: np.ndarray, linkage: str = "WPGMA", cut: float = 0.9) -> list[list[int]]:
    """Clusters of items whose merges stay within a distance; of equally near pairs the first merges first.

    Centroid and Ward linkages work on squared distances.
    """
    squared = linkage in ("UPGMC", "WPGMC", "WARD")
    d = {frozenset(p): distance[p] ** 2 if squared else distance[p] for p in itertools.combinations(range(len(distance)), 2)}
    members = {i: [i] for i in range(len(distance))}
    while len(members) > 1:
        pair = min(itertools.combinations(sorted(members), 2), key=lambda p: (d[frozenset(p)], p))
        near = d[frozenset(pair)]
        if (np.sqrt(max(near, 0.0)) if squared else near) > cut:
            break
        i, j = pair
        for k in members:
            if k not in pair:
                x, y, z, w = _coefficients(linkage, len(members[i]), len(members[j]), len(members[k]))
                a, b = d[frozenset((i, k))], d[frozenset((j, k))]
                d[frozenset((i, k))] = x * a + y * b + z * near + w * abs(a - b)
        members[i] = members[i] + members.pop(j)
    return [sorted(m) for _, m in sorted(members.items())]


def representatives(motifs: list[Motif], clusters: list[list[int]]) -> list[Motif]:
    """The best motif of each cluster, by score and then name."""
    return [min((motifs[i] for i in c), key=lambda m: (-m.score, m.name)) for c in clusters]


def combine(profiles: DataFrame, names: list[str], labels: DataFrame) -> DataFrame:
    """(motifs, auc) of every set of motifs: the sum of a sequence's best scores as one score, ranked against the labels.

    profiles: (seq_id, motif, score). 2 ** motifs - 1 sets, all evaluated by one plan.
    """
    from .metrics import auc

    sets = [list(c) for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)]
    table = profiles.sparkSession.createDataFrame([("+".join(s), m) for s in sets for m in s], "motifs string, motif string")
    scored = profiles.join(F.broadcast(table), "motif").groupBy("motifs", "seq_id").agg(F.round(F.sum("score"), 9).alias("score")).join(labels, "seq_id")
    return auc(scored.select("motifs", "score", "label"), "motifs")


def profile_scores(sequences: DataFrame, motifs: list[Motif], reach: int, strands: bool = False, chunk: int = 1 << 19) -> DataFrame:
    """(motifs, seq_id, score) of every set of motifs: the greatest sum, over the places of a sequence, of the motifs' best windows
    that begin within ``reach`` of the place. strands: the windows of a sum have to be on one strand.

    One pass over the sequences for all sets; a set of which a motif has no window in a sequence gives no row. A long sequence is
    one piece here: a profile has as many numbers as letters.
    """
    sets = [list(c) for k in range(1, len(motifs) + 1) for c in itertools.combinations(range(len(motifs)), k)]

    def profile(codes, row, offsets, m, logs, groups):
        """The best window within reach of each place, on padded sequences, so that none is reached from another one."""
        n, pad = len(offsets) - 1, reach + 1
        value = np.full(len(codes) + n * pad + reach, -np.inf)
        found = scores(codes, logs, groups)
        at = np.arange(len(found))
        inside = at + len(m) <= offsets[row[: len(found)] + 1]
        value[reach + at[inside] + row[: len(found)][inside] * pad] = found[inside]
        width, top, done = 2 * reach + 1, value, 1
        while done < width:  # running maxima of a width that doubles
            step = min(done, width - done)
            top = np.concatenate([np.maximum(top[:-step], top[step:]), top[-step:]])
            done += step
        return top[np.arange(len(codes)) + row * pad]

    def found(batches):
        for batch in batches:
            codes, offsets = numbered(batch.column("seq"))
            ids, low = batch.column("seq_id"), 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + chunk, side="right")) - 1)
                part, cut = codes[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                row = np.repeat(np.arange(high - low), np.diff(cut))
                full = np.flatnonzero(np.diff(cut) > 0)
                both = [[profile(part, row, cut, m, x.logs, x.group_logs()) for x in (m, m.reverse_complement())] for m in motifs]
                for s in sets if len(full) else []:
                    if strands:
                        total = np.maximum(sum(both[i][0] for i in s), sum(both[i][1] for i in s))
                    else:
                        total = sum(np.maximum(*both[i]) for i in s)
                    best = np.maximum.reduceat(total, cut[full])
                    good = np.isfinite(best)
                    name = "+".join(motifs[i].name for i in s)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * int(good.sum())), ids.take(pa.array(low + full[good])), pa.array(np.round(best[good], 9))], ["motifs", "seq_id", "score"])
                low = high

    return sequences.select("seq_id", "seq").mapInArrow(found, "motifs string, seq_id long, score double")


def dependence(sites: DataFrame, columns: list[int], keep: int) -> DataFrame:
    """(word, n, p, q, kl): joint frequencies of some columns of aligned sites against the product of the columns' own.

    sites: (site). The ``keep`` most frequent words and, as N, all others together.
    """
    from pyspark.sql import Window

    letters = sites.select(*(F.substring("site", c + 1, 1).alias(f"c{i}") for i, c in enumerate(columns)))
    joint = letters.groupBy(F.concat(*letters.columns).alias("word")).agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("total"))
    out = joint.crossJoin(F.broadcast(total))
    for i in range(len(columns)):  # each column's own frequencies are a few rows
        own = letters.groupBy(F.col(f"c{i}").alias(f"b{i}")).agg(F.count("*").alias(f"n{i}"))
        out = out.join(F.broadcast(own), F.substring("word", i + 1, 1) == F.col(f"b{i}"))
    q = F.lit(1.0)
    for i in range(len(columns)):
        q = q * F.col(f"n{i}") / F.col("total")
    ranked = out.select("word", "n", (F.col("n") / F.col("total")).alias("p"), q.alias("q")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "word")))  # 4 ** columns rows at most
    merged = ranked.groupBy(F.when(F.col("r") <= keep, F.col("word")).otherwise("N").alias("word")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return merged.withColumn("kl", F.col("p") * F.log(F.col("p") / F.col("q")))


def joint_counts(sites: DataFrame, groups: list[tuple[int, ...]]) -> dict[tuple[int, ...], dict[str, int]]:
    """How often each word stands at each group of columns of aligned sites (site), all groups in one pass; 4 ** columns numbers
    of each group come to the driver."""
    if not groups:
        return {}
    words = F.array(*(F.struct(F.lit(i).alias("g"), F.concat(*(F.substring("site", c + 1, 1) for c in g)).alias("word")) for i, g in enumerate(groups)))
    rows = sites.select(F.explode(words).alias("x")).groupBy("x.g", "x.word").agg(F.count("*").alias("n")).collect()
    out: dict[tuple[int, ...], dict[str, int]] = {g: {} for g in groups}
    for r in rows:
        out[groups[r["g"]]][r["word"]] = r["n"]
    return out


def dependence_score(joint: dict[str, int], single: list[dict[str, int]], keep: int) -> float:
    """What is gained by the joint frequencies of some columns over the product of the columns' own: the divergence of the
    ``keep`` most frequent words, and of all others together, in nats a site."""
    total = sum(joint.values())
    if not total:
        return 0.0
    rows = [(n, w, n / total, float(np.prod([s[b] / total for s, b in zip(single, w, strict=True)]))) for w, n in joint.items()]
    rows.sort(key=lambda r: (-r[0], r[1]))
    kept = [(p, q) for _, _, p, q in rows[:keep]]
    if rest := rows[keep:]:
        kept.append((sum(r[2] for r in rest), sum(r[3] for r in rest)))
    return float(sum(p * np.log(p / q) for p, q in kept if p > 0 and q > 0))


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring."""
    if not a or not b:
        return 0
    y = np.frombuffer(b.encode(), dtype=np.uint8)
    run, best = np.zeros(len(y) + 1, dtype=np.int32), 0
    for c in a.encode():
        new = np.zeros_like(run)
        new[1:] = np.where(y == c, run[:-1] + 1, 0)
        run, best = new, max(best, int(new.max()))
    return best


#: Sequences of a frequent k-mer that are compared with the others in one task.
BLOCK = 1024


def similar_sequences(sequences: DataFrame, k: int = 18, shared: int = 4) -> DataFrame:
    """(a, b, n_shared, longest): pairs of sequences with ``shared`` or more distinct k-mers in common, on either strand, and
    the length of their longest common substring. K-mers of a sequence count once; the pairs meet by k-mer. The sequences of a
    frequent k-mer are dealt in blocks of about ``BLOCK``, so that none of its pairs' tasks has more than a block on one side."""
    own = kmers.explode(sequences, k).select("seq_id", F.xxhash64(dna.canonical("kmer")).alias("h")).distinct()
    met = own.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = own.join(met, "h")
    left = own.select(F.col("seq_id").alias("a"), "h", F.expr("cast(pmod(xxhash64(seq_id), blocks) AS int)").alias("block"))
    right = own.select(F.col("seq_id").alias("b"), "h", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    pairs = left.join(right, ["h", "block"]).where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= shared)

    @F.pandas_udf("int")
    def longest(x: pd.Series, y: pd.Series) -> pd.Series:
        flip = str.maketrans("ACGT", "TGCA")
        return pd.Series([max(longest_common(s, t), longest_common(s, t.translate(flip)[::-1])) for s, t in zip(x, y, strict=True)], dtype="int32")

    text = lambda c: sequences.select(F.col("seq_id").alias(c), F.col("seq").alias(f"seq_{c}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "n_shared", longest("seq_a", "seq_b").alias("longest"))
