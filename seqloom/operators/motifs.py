"""Position weight matrices: small driver-side objects that scans broadcast, and their table form."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.dna import BASES

TINY = 1e-14
#: The bases that IUPAC codes stand for.
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def normalise(weights) -> np.ndarray:
    """Negative entries become 0, a zero sum becomes uniform; a tiny amount is added to each entry before the division."""
    w = np.maximum(np.asarray(weights, dtype=float), 0.0)
    total = w.sum(axis=-1, keepdims=True)
    return np.where(total > 0, (w + TINY) / np.where(total > 0, total, 1.0), 1.0 / w.shape[-1])


def _mirrored(word: str) -> str:
    return word if word == "N" else word.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@dataclass
class Motif:
    """Columns x 4 probabilities in the order A, C, G, T."""

    name: str
    weights: np.ndarray
    score: float = 0.0
    sites: float = 0.0
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        self.weights = np.asarray(self.weights, dtype=float).reshape(-1, 4)

    @classmethod
    def of_consensus(cls, name: str, consensus: str, strength: float = 0.85, **more) -> Motif:
        """Columns that give ``strength`` to the bases of each code together and the rest to the others; N is uniform."""
        rows = []
        for c in consensus:
            own = CODES[c]
            rows.append([0.25] * 4 if len(own) == 4 else [strength / len(own) if b in own else (1 - strength) / (4 - len(own)) for b in BASES])
        return cls(name, np.array(rows), **more)

    def __len__(self) -> int:
        return len(self.weights)

    @property
    def logs(self) -> np.ndarray:
        return np.log(normalise(self.weights))

    def reverse_complement(self) -> Motif:
        extra = dict(self.extra)
        if "groups" in extra:
            extra["groups"] = {tuple(len(self) - 1 - c for c in reversed(columns)): {_mirrored(w): p for w, p in words.items()} for columns, words in extra["groups"].items()}
        return Motif(self.name, self.weights[::-1, ::-1], self.score, self.sites, extra)

    def with_groups(self, groups: dict[tuple[int, ...], dict[str, float]]) -> Motif:
        """The motif with joint probabilities of words at some columns, in place of the columns' own; N stands for all other words."""
        return Motif(self.name, self.weights, self.score, self.sites, {**self.extra, "groups": groups})

    def group_logs(self) -> list[tuple[tuple[int, ...], np.ndarray]]:
        """Of each group: its columns, and the log probability of every word, by its number to base 5 (4: other letters).

        What N has is shared by the words that aren't listed; words with other letters get the least of all.
        """
        out = []
        for columns, words in self.extra.get("groups", {}).items():
            d = len(columns)
            listed = {w: p for w, p in words.items() if set(w) <= set(BASES)}
            rest = max(words.get("N", 1 - sum(listed.values())), TINY) / max(4**d - len(listed), 1)
            logs = np.full(5**d, np.log(rest))
            for w, p in listed.items():
                logs[int("".join(str(BASES.index(b)) for b in w), 5)] = np.log(max(p, TINY))
            other = [i for i in range(5**d) if "4" in np.base_repr(i, 5)]
            logs[other] = logs.min()
            out.append((columns, logs))
        return out

    def parameters(self) -> int:
        """Free numbers: three for each column outside groups, and the listed words of each group."""
        grouped = {c for columns in self.extra.get("groups", {}) for c in columns}
        return 3 * (len(self) - len(grouped)) + sum(len([w for w in words if w != "N"]) for words in self.extra.get("groups", {}).values())

    def sub(self, start: int, end: int) -> Motif:
        return Motif(self.name, self.weights[start:end], self.score, self.sites, dict(self.extra))

    def information(self) -> np.ndarray:
        """Bits of each column: 2 minus its entropy."""
        p = normalise(self.weights)
        return 2 + (p * np.log2(p)).sum(axis=1)

    def core(self, bits: float = 0.4, least: int = 8) -> tuple[int, int]:
        """Start and end of what is left when columns of few bits are trimmed from both ends, if more than ``least`` are."""
        good = np.flatnonzero(self.information() > bits)
        if len(self) <= least or not len(good):
            return 0, len(self)
        return int(good[0]), int(good[-1]) + 1

    def trimmed(self, bits: float = 0.4, least: int = 8) -> Motif:
        return self.sub(*self.core(bits, least))

    def best(self) -> str:
        """The likeliest base of each column, the first by name of equally likely ones."""
        return "".join(BASES[i] for i in self.weights.argmax(axis=1))

    def consensus(self, above: float = 0.26) -> str:
        """IUPAC codes of the bases above a weight in each column."""
        letter = {v: k for k, v in CODES.items()}
        return "".join(letter.get("".join(b for b, w in zip(BASES, row, strict=True) if w > above), "N") for row in normalise(self.weights))

    def order(self) -> np.ndarray:
        """Bases of each column by falling weight."""
        return np.argsort(-self.weights, axis=1, kind="stable")

    def shuffled(self, seed: int = 12345678) -> Motif:
        """The columns in the order of a hash of the seed, the name and their number."""
        order = sorted(range(len(self)), key=lambda c: hashlib.md5(f"{seed}:{self.name}:{c}".encode()).hexdigest())
        return Motif(self.name, self.weights[order], self.score, self.sites)


def from_sites(name: str, sites: list[str], weights=None) -> Motif:
    """The weighted counts of bases at each place of aligned sites; other letters add a quarter to each base."""
    counts = np.zeros((max(map(len, sites), default=0), 4))
    for s, w in zip(sites, weights if weights is not None else [1.0] * len(sites), strict=True):
        for i, c in enumerate(s):
            if c in BASES:
                counts[i, BASES.index(c)] += w
            else:
                counts[i] += w / 4
    return Motif(name, normalise(counts))


MOTIF_SCHEMA = "motif string, col int, base string, w double, logw double"


def table(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    """(motif, col, base, w, logw): four rows for each column."""
    rows = [(m.name, c, b, float(m.weights[c, k]), float(m.logs[c, k])) for m in motifs for c in range(len(m)) for k, b in enumerate(BASES)]
    return spark.createDataFrame(rows, MOTIF_SCHEMA)


def alignments(p: np.ndarray, q: np.ndarray, least: int = 7):
    """(offset, divergence) of all overlaps of q with p by ``least`` columns, or the shorter one's length less 2.

    The divergence is the mean Euclidean distance of overlapping columns over the root of 2; a column at offset + i of p meets
    column i of q.
    """
    enough = min(least, min(len(p), len(q)) - 2)
    for offset in range(1 - len(q), len(p)):
        a, b = max(0, offset), min(len(p), offset + len(q))
        if b - a >= max(1, enough):
            yield offset, float(np.sqrt(((p[a:b] - q[a - offset : b - offset]) ** 2).sum(axis=1)).mean() / np.sqrt(2))


def divergence(p: Motif, q: Motif, least: int = 7) -> float:
    """The least divergence of all alignments of p with q or q's reverse complement."""
    return min(d for m in (q, q.reverse_complement()) for _, d in alignments(p.weights, m.weights, least))
