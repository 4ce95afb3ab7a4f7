"""The E8 lattice: nearest points and neighbouring cells, for rows of 8 numbers."""

from __future__ import annotations

import itertools

import numpy as np


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row; of two as near, the one with integer coordinates."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def shortest() -> np.ndarray:
    """The 240 shortest vectors: from a point to its neighbours."""
    whole = [tuple(a if k == i else b if k == j else 0 for k in range(8)) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(s) % 2 == 0]
    return np.array(whole + half, dtype=np.float64)


SHORTEST = shortest()


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """[rows, 1 + probes, 8]: the nearest point and the neighbours of it that are nearest to the row, doubled to integers."""
    home = nearest(x)
    out = [home]
    if probes:
        gain = (x - home) @ SHORTEST.T
        order = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        out += [home + SHORTEST[order[:, k]] for k in range(probes)]
    return np.rint(2 * np.stack(out, axis=1)).astype(np.int64)
