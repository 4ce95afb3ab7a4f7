"""Expectation maximisation for motifs.

The model is a few hundred numbers on the driver. A round is one narrow pass over the sequences, for all motifs together: each
task adds up its expected base counts and emits a few rows for each motif, Spark sums them, and the driver updates the model. So a round costs one
scan and a shuffle of (tasks x columns x 4) rows, and nothing is kept between rounds but the model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special, stats
from .motifs import Motif, normalise
from .sampling import uniform
from .scan import numbered, scan, scores

COUNTS = "motif string, col int, base int, n double"
#: Log-odds of a window are cut here, lest one site outweighs all.
CAP = 10.0


@dataclass
class State:
    """A motif and the share of sequences (or of windows, ``mode`` "any") that hold a site."""

    motif: Motif
    share: float = 0.5


def _chances(codes, offsets, state: State, background: np.ndarray, mode: str, keep: np.ndarray | None = None):
    """(row, place, f, r, total) of all windows of a batch: the chances that a site begins there on either strand, and what they
    were divided by, for a sequence in mode "one" and for a window in mode "any".

    keep: the logs of the chances that letters belong to no other motif's site, which a window's likelihood is multiplied by.
    """
    m, width = state.motif, len(state.motif)
    odds = np.log(normalise(m.weights)) - np.log(background)
    n = np.diff(offsets)
    places = np.maximum(n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), places)
    at = np.arange(len(row)) - np.repeat(np.cumsum(places) - places, places) + offsets[:-1][row]
    if not len(at):
        return row, at, np.zeros(0), np.zeros(0), np.ones(len(n) if mode == "one" else 0)
    # scores count other letters as ln 0.25; as log-odds they count nothing
    more = np.where(codes == 4, -np.log(0.25), 0.0) + (0.0 if keep is None else keep)
    gap = np.concatenate([[0.0], np.cumsum(more)])
    other = gap[at + width] - gap[at]
    ratio = [np.exp(np.minimum(scores(codes, s)[at] + other, CAP)) for s in (odds, odds[::-1, ::-1])]
    prior = state.share / 2 / (places[row] if mode == "one" else 1.0)
    f, r = prior * ratio[0], prior * ratio[1]
    if mode == "one":  # at most one site in a sequence
        total = 1 - state.share + np.bincount(row, weights=f + r, minlength=len(n))
        return row, at, f / total[row], r / total[row], total
    total = 1 - state.share + f + r
    return row, at, f / total, r / total, total


def _expected(codes, offsets, state: State, background: np.ndarray, mode: str, flank: int, weights, keep=None):
    """Expected base counts of columns -flank .. width + flank of a batch, sites, log-likelihood gain."""
    width = len(state.motif)
    counts = np.zeros((width + 2 * flank, 4))
    row, at, f, r, total = _chances(codes, offsets, state, background, mode, keep)
    if not len(at):
        return counts, 0.0, 0.0
    held = np.diff(offsets) >= width
    gain = float((np.log(total[held]) * weights[held]).sum() if mode == "one" else (np.log(total) * weights[row]).sum())
    f, r = f * weights[row], r * weights[row]
    sites = float(f.sum() + r.sum())
    for c in range(-flank, width + flank):
        for z, place, mirror in ((f, at + c, False), (r, at + width - 1 - c, True)):
            inside = (place >= offsets[row]) & (place < offsets[row + 1])
            code = codes[place[inside]]
            found = np.bincount(code, weights=z[inside], minlength=5)
            found = found[:4] + found[4] / 4
            counts[c + flank] += found[::-1] if mirror else found
    return counts, sites, gain


def _kept(column: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """The log of the chance that each letter belongs to no site, from lists of sites (pos, width, z) of each sequence."""
    change = np.zeros(int(offsets[-1]) + 1)
    lists = column.fill_null([]) if column.null_count else column
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    log = np.log1p(-np.minimum(flat.field("z").to_numpy(), 1 - 1e-9))
    start = offsets[row] + flat.field("pos").to_numpy()
    np.add.at(change, start, log)
    np.add.at(change, np.minimum(start + flat.field("width").to_numpy(), offsets[row + 1]), -log)
    return np.minimum(np.cumsum(change)[:-1], 0.0)


def _batches(batches, weight: bool, erased: bool):
    """(ids, codes, offsets, weights, keep) of runs of a batch's sequences with about half a million letters."""
    for batch in batches:
        codes, offsets = numbered(batch.column("seq"))
        weights = np.nan_to_num(batch.column("w").to_numpy(zero_copy_only=False)) if weight else np.ones(len(batch))
        keep = _kept(batch.column("erased"), offsets) if erased else None
        low = 0
        while low < len(weights):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 19), side="right")) - 1)
            a, b = offsets[low], offsets[high]
            yield batch.column("seq_id").slice(low, high - low) if "seq_id" in batch.schema.names else None, codes[a:b], offsets[low : high + 1] - a, weights[low:high], None if keep is None else keep[a:b]
            low = high


def expected_counts(sequences: DataFrame, states: list[State], background: np.ndarray, mode: str = "one", flank: int = 0, weight: str | None = None, erased: str | None = None) -> dict[str, tuple[np.ndarray, float, float]]:
    """Of each motif: expected base counts [columns and flanks, 4], expected sites, log-likelihood gain over the background.

    erased: a column with lists of other motifs' sites (pos, width, z), whose letters count less for what z is.
    """
    columns = ["seq", (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")]
    rows = sequences.select(*columns, *([F.col(erased).alias("erased")] if erased else []))

    def partial(batches):
        totals = {s.motif.name: [np.zeros((len(s.motif) + 2 * flank, 4)), 0.0, 0.0] for s in states}
        for _, codes, offsets, weights, keep in _batches(batches, True, erased is not None):
            for s in states:
                for i, x in enumerate(_expected(codes, offsets, s, background, mode, flank, weights, keep)):
                    totals[s.motif.name][i] = totals[s.motif.name][i] + x
        for name, (counts, sites, gain) in totals.items():
            col, base = np.indices(counts.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (counts.size + 2)), pa.array(np.append(col.ravel() - flank, [1 << 20, 1 << 21]).astype(np.int32)), pa.array(np.append(base.ravel(), [0, 0]).astype(np.int32)), pa.array(np.append(counts.ravel(), [sites, gain]))],
                ["motif", "col", "base", "n"],
            )

    found = rows.mapInArrow(partial, COUNTS).groupBy("motif", "col", "base").agg(F.sum("n").alias("n")).collect()
    out = {}
    for s in states:
        counts, extra = np.zeros((len(s.motif) + 2 * flank, 4)), {}
        for r in found:
            if r["motif"] == s.motif.name:
                if r["col"] >= 1 << 20:
                    extra[r["col"]] = r["n"]
                else:
                    counts[r["col"] + flank, r["base"]] = r["n"]
        out[s.motif.name] = counts, extra.get(1 << 20, 0.0), extra.get(1 << 21, 0.0)
    return out


def sites(sequences: DataFrame, state: State, background: np.ndarray, mode: str = "one", least: float = 0.01) -> DataFrame:
    """(seq_id, pos, width, z) of the windows that are a site, on either strand, with a chance of ``least`` or more."""

    def found(batches):
        for ids, codes, offsets, _, _ in _batches(batches, False, False):
            row, at, f, r, _ = _chances(codes, offsets, state, background, mode)
            z = f + r
            good = np.flatnonzero(z >= least)
            width = pa.array(np.full(len(good), len(state.motif), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[good])), pa.array((at - offsets[row])[good].astype(np.int32)), width, pa.array(z[good])], ["seq_id", "pos", "width", "z"])

    return sequences.select("seq_id", "seq").mapInArrow(found, "seq_id long, pos int, width int, z double")


def erasing(sequences: DataFrame, found: DataFrame) -> DataFrame:
    """sequences with ``erased``: the lists of a sequence's sites (seq_id, pos, width, z)."""
    lists = found.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "z"))).alias("erased"))
    return sequences.join(lists, "seq_id", "left")


def _places(sequences: DataFrame, states: list[State], mode: str) -> dict[str, float]:
    """Where each motif may have a site: once in a sequence in mode "one", in every window in mode "any"."""
    if mode == "one":
        return dict.fromkeys((s.motif.name for s in states), float(sequences.count()))
    widths = sorted({len(s.motif) for s in states})
    row = sequences.agg(*(F.sum(F.greatest(F.length("seq") - w + 1, F.lit(0))).alias(f"w{w}") for w in widths)).first()
    return {s.motif.name: float(row[f"w{len(s.motif)}"] or 0) for s in states}


def step(sequences: DataFrame, states: list[State], background: np.ndarray, mode: str = "one", weight: str | None = None, n: float | dict[str, float] | None = None, erased: str | None = None) -> tuple[list[State], dict[str, float]]:
    """One round of all motifs: the new states and the gains of the old ones. n: what the shares are of, for each motif if it's
    a dictionary; else the places of ``_places``."""
    n = _places(sequences, states, mode) if n is None else n
    found = expected_counts(sequences, states, background, mode, 0, weight, erased)
    new, gains = [], {}
    for s in states:
        counts, sites, gain = found[s.motif.name]
        weights = normalise(counts + background)  # one site's worth of background
        of = n[s.motif.name] if isinstance(n, dict) else n
        new.append(State(Motif(s.motif.name, weights, gain, sites), float(np.clip(sites / max(of, 1.0), 1e-6, 1 - 1e-6))))
        gains[s.motif.name] = gain
    return new, gains


def fit(sequences: DataFrame, states: list[State], background: np.ndarray, rounds: int = 50, tolerance: float = 1e-3, mode: str = "one", **more) -> list[State]:
    """Rounds until no weight of any motif moves by more than the tolerance."""
    n = _places(sequences, states, mode)
    for _ in range(rounds):
        new, _ = step(sequences, states, background, mode, n=n, **more)
        moved = max(float(np.abs(a.motif.weights - b.motif.weights).max()) for a, b in zip(new, states, strict=True))
        states = new
        if moved < tolerance:
            break
    return states


#: The probability that a certain base of a seed keeps, in motifs of 10 columns and more and in shorter ones.
DILUTED_LONG, DILUTED_SHORT = 0.504166667, 0.704166667


def diluted(motif: Motif) -> Motif:
    """Columns with a certain base give some of its probability to the others, in equal shares."""
    main = DILUTED_LONG if len(motif) >= 10 else DILUTED_SHORT
    certain = motif.weights.max(axis=1, keepdims=True) > 0.9999
    weights = np.where(certain, np.where(motif.weights > main, main, (1 - main) / 3), motif.weights)
    return Motif(motif.name, weights, motif.score, motif.sites)


def resampled(sequences: DataFrame, seed: Motif, background: np.ndarray, keep, *, ratio: float = 0.01, least: int = 1000, rounds: int = 51, tolerance: float = 1e-3, draw: int = 11) -> tuple[State, int]:
    """EM over a sample of windows instead of all of them: the state, and how many rounds it took.

    The diluted seed's likelihood decides how likely a window is to be drawn, so that about ``ratio`` of all windows are, or
    ``least``, and a drawn window counts for one over its chance. The sample is drawn once and kept, by ``keep``, a function
    that writes a table; rounds go on until the motif moves by less than the tolerance.
    """
    motif = diluted(seed)
    found = scan(sequences, [motif], None, sites=True)
    gain = F.exp(F.col("score") + len(motif) * F.log(F.lit(4.0)))
    n, total = found.agg(F.count("*"), F.sum(gain)).first()
    if not n:
        return State(motif, 1e-6), 0
    chance = F.least(F.lit(1.0), gain * (max(least, ratio * n) / total))
    drawn = found.withColumn("p", chance).where(uniform(draw, F.concat_ws(":", "seq_id", "pos")) < F.col("p"))
    sample = keep(drawn.select(F.col("site").alias("seq"), (1 / F.col("p")).alias("w")))
    windows = sample.agg(F.sum("w")).first()[0] or 1.0
    state, done = State(motif, min(0.5 * sequences.count() / n, 0.5)), 0
    for done in range(1, rounds + 1):
        (new,), _ = step(sample, [state], background, "any", "w", windows)
        moved = np.sqrt(((new.motif.weights - state.motif.weights) ** 2).sum(axis=1)).mean() / np.sqrt(2)
        state = new
        if moved < tolerance:
            break
    return state, done


def extend(sequences: DataFrame, states: list[State], background: np.ndarray, *, least: int = 7, most: int = 25, reach: int = 3, alpha: float = 0.05, mode: str = "one", rounds: int = 12) -> list[State]:
    """Motifs widened by the flanking column of most information, as long as it differs from the background by a chi-square
    test or the motif is shorter than ``least``; each widening is a round of all motifs together."""
    open_states = {s.motif.name: s for s in states}
    done: dict[str, State] = {}
    for _ in range(rounds):
        if not open_states:
            break
        found = expected_counts(sequences, list(open_states.values()), background, mode, reach)
        for name, s in list(open_states.items()):
            counts, sites, _ = found[name]
            width = len(s.motif)
            p = normalise(counts + background)
            flanks = [reach - 1 - i for i in range(reach)] + [reach + width + i for i in range(reach)]
            gain = {c: float((p[c] * np.log(p[c] / background)).sum()) for c in flanks}
            best = max(flanks, key=lambda c: (gain[c], -abs(c - reach - width / 2)))
            total = counts[best].sum()
            chi = float(((counts[best] - total * background) ** 2 / np.maximum(total * background, 1e-12)).sum())
            low, high = min(best, reach), max(best + 1, reach + width)
            if high - low <= most and (width < least or stats.chi_square_tail(chi, 3) < alpha):
                open_states[name] = State(Motif(name, p[low:high], s.motif.score, sites), s.share)
            else:
                done[name] = open_states.pop(name)
    return [done.get(s.motif.name, open_states.get(s.motif.name, s)) for s in states]


def log_odds_by_sequence(best: DataFrame, width: int) -> DataFrame:
    """(motif, total, top): sum over sequences of the best window's log-odds over a uniform background, and the largest."""
    odds = F.col("score") - width * F.log(F.lit(0.25))
    return best.groupBy("motif").agg(F.sum(odds).alias("total"), F.max(odds).alias("top"))


def logistic(rows: DataFrame, features: list[str], label: str, rounds: int = 50, penalty: float = 1e-3, tolerance: float = 1e-10) -> np.ndarray:
    """Weights of the features and, last, the intercept of a logistic regression: Newton steps, one aggregate each."""
    k = len(features) + 1
    x = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    w = np.zeros(k)
    for _ in range(rounds):
        z = sum((float(a) * b for a, b in zip(w, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        sums = [F.sum((F.col(label) - p) * x[i]).alias(f"g{i}") for i in range(k)] + [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        row = rows.agg(*sums).first()
        if row["g0"] is None:
            break
        gradient = np.array([row[f"g{i}"] for i in range(k)]) - penalty * w
        hessian = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty * np.eye(k)
        delta = np.linalg.solve(hessian, gradient)
        w = w + np.clip(delta, -2, 2)
        if np.abs(delta).max() < tolerance:
            break
    return w


def negative_binomial_mixture(rows: DataFrame, value: str, rounds: int = 30, tolerance: float = 1e-6) -> list[tuple[float, float, float]]:
    """(share, r, p) of two negative binomials, the one of the lesser mean first: EM, one aggregate a round.

    A component's r and p are those of its mean and variance; where the variance isn't above the mean, r is large.
    """
    x = F.col(value).cast("double")
    n, mean, square = rows.agg(F.count(x), F.avg(x), F.avg(x * x)).first()
    if not n:
        return []

    def of(mean: float, variance: float) -> tuple[float, float]:
        mean = max(mean, 1e-9)
        r = mean * mean / (variance - mean) if variance > mean * (1 + 1e-6) else 1e6
        return r, r / (r + mean)

    spread = max(square - mean * mean, 1e-9)
    parts = [(0.5, *of(mean / 2, spread / 4)), (0.5, *of(mean * 1.5, spread))]
    for _ in range(rounds):
        logs = [math.log(max(s, 1e-12)) + special.negative_binomial(x, r, p) for s, r, p in parts]
        z = 1 / (1 + F.exp(F.greatest(F.least(logs[1] - logs[0], F.lit(700.0)), F.lit(-700.0))))
        sums = rows.agg(*(F.sum(w * v) for w in (z, 1 - z) for v in (F.lit(1.0), x, x * x))).first()
        new = []
        for i in (0, 3):
            c = max(sums[i], 1e-9)
            new.append((sums[i] / n, *of(sums[i + 1] / c, sums[i + 2] / c - (sums[i + 1] / c) ** 2)))
        moved = max(abs(a - b) / max(abs(b), 1e-9) for x1, x2 in zip(new, parts, strict=True) for a, b in zip(x1, x2, strict=True))
        parts = new
        if moved < tolerance:
            break
    return sorted(parts, key=lambda c: c[1] * (1 - c[2]) / c[2])


def mixing_share(rows: DataFrame, ratio: str, rounds: int = 60, tolerance: float = 1e-10) -> float:
    """The share x that maximises sum ln(1 - x + x r): Newton steps inside [0, 1], one aggregate a round."""
    x = 0.5
    for _ in range(rounds):
        slope = (F.col(ratio) - 1) / (1 - x + x * F.col(ratio))
        first, second = rows.agg(F.sum(slope), F.sum(slope * slope)).first()
        if not second:
            break
        new = min(max(x + first / second, x / 10), 1 - (1 - x) / 10)
        if abs(new - x) < tolerance:
            return new
        x = new
    return x
