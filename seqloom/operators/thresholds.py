"""Score thresholds: the distribution of a motif's score under a background, its columns' scores being rounded to 1/scale, and
instances of most probability."""

from __future__ import annotations

import heapq

import numpy as np

from ..functions.dna import BASES
from .motifs import Motif, normalise


def score_distribution(motif: Motif, background=None, scale: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of random windows, by dynamic programming on scores rounded to 1/scale."""
    q = np.full(4, 0.25) if background is None else np.asarray(background, dtype=float)
    steps = np.rint(motif.logs * scale).astype(np.int64)
    low = int(steps.min(axis=1).sum())
    p = np.ones(1)
    floor = 0
    for row in steps:
        least = int(row.min())
        new = np.zeros(len(p) + int(row.max()) - least)
        for k in range(4):
            new[row[k] - least : row[k] - least + len(p)] += p * q[k]
        p, floor = new, floor + least
    keep = p > 0
    return (np.arange(len(p))[keep] + low) / scale, p[keep]


def threshold(motif: Motif, rate: float, background=None, scale: int = 1000) -> float:
    """The least score that random windows reach with a probability of at most ``rate``."""
    scores, p = score_distribution(motif, background, scale)
    tail = np.cumsum(p[::-1])[::-1]
    ok = np.flatnonzero(tail <= rate)
    return float(scores[ok[0]]) if len(ok) else float(scores[-1]) + 1 / scale


def false_rate(motif: Motif, score: float, background=None, scale: int = 1000) -> float:
    """The probability that a random window reaches a score."""
    scores, p = score_distribution(motif, background, scale)
    return float(p[scores >= score - 0.5 / scale].sum())


def instances(motif: Motif, mass: float) -> list[tuple[str, float]]:
    """The likeliest strings of a motif, in order, until their probability adds up to ``mass``, with all strings that are as
    likely as the last one: a best-first search. As many as that takes, so a wide motif's mass has to be chosen with care."""
    p = normalise(motif.weights)
    order = np.argsort(-p, axis=1, kind="stable")
    value = np.take_along_axis(np.log(p), order, axis=1)
    start = (0,) * len(p)
    heap, seen, out, total, level = [(-value[:, 0].sum(), start)], {start}, [], 0.0, -np.inf
    while heap:
        negative, state = heapq.heappop(heap)
        if negative > level + 1e-9:
            if total >= mass:
                break
            level = negative
        probability = float(np.exp(-negative))
        out.append(("".join(BASES[order[i, s]] for i, s in enumerate(state)), probability))
        total += probability
        for i, s in enumerate(state):
            if s < 3 and (after := (*state[:i], s + 1, *state[i + 1 :])) not in seen:
                seen.add(after)
                heapq.heappush(heap, (negative + value[i, s] - value[i, s + 1], after))
    return out
