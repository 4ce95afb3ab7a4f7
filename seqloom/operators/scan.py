"""Scanning sequences with weight matrices, both strands.

A batch's sequences are one array of base numbers, so a motif's scores at all places are one gather and one sum for each of its
columns; nothing is made for a window that isn't a hit. Scores are rounded to 9 decimals, so that the order in which columns
are added decides no tie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .motifs import Motif

_NUMBER = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _NUMBER[_c] = _i

_LETTER = np.frombuffer(b"ACGTN", dtype=np.uint8)

HITS = "seq_id long, motif string, pos int, reverse boolean, score double"


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base numbers (4: other letters) of all sequences, and their offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, raw, body = texts.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    return _NUMBER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]


def scores(codes: np.ndarray, logs: np.ndarray, groups=()) -> np.ndarray:
    """The sum of log weights of the window that starts at each place; other letters count as a quarter.

    groups: columns that count jointly, with the log probabilities of their words, in place of the columns' own weights.
    """
    n = len(codes) - len(logs) + 1
    if n <= 0:
        return np.zeros(0)
    full = np.concatenate([logs, np.full((len(logs), 1), np.log(0.25))], axis=1)
    total, joint = np.zeros(n), {c for columns, _ in groups for c in columns}
    for c in range(len(logs)):
        if c not in joint:
            total += full[c][codes[c : c + n]]
    for columns, table in groups:
        word = np.zeros(n, dtype=np.int64)
        for c in columns:
            word = word * 5 + codes[c : c + n]
        total += table[word]
    return np.round(total, 9)


def both_strands(codes: np.ndarray, motif: Motif) -> tuple[np.ndarray, np.ndarray]:
    """The better strand's score at each place, and whether it is the reverse one, which has to be greater."""
    back = motif.reverse_complement()
    forward, backward = scores(codes, motif.logs, motif.group_logs()), scores(codes, back.logs, back.group_logs())
    return np.maximum(forward, backward), backward > forward


LOCATED = f"{HITS}, width int, seq_len int, weight double"


def _tiles(offsets: np.ndarray, width: int, chunk: int):
    """(first row, row after the last, first place, place after the last window's start) of runs of sequences of about ``chunk``
    letters, and of parts of a longer sequence; the windows that begin in a part may end behind it."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + chunk, side="right")) - 1)
        for start in range(int(offsets[low]), int(offsets[high]), chunk) if high == low + 1 else (int(offsets[low]),):
            yield low, high, start, min(start + chunk, int(offsets[high])) if high == low + 1 else int(offsets[high])
        low = high


def _best(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The places in the lists of each row's greatest value, the first of equal ones."""
    order = np.lexsort((at, -value, row))
    return order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order


def scan(sequences: DataFrame, motifs: list[Motif], threshold: float | dict[str, float] | None = None, best_only: bool = False, located: bool = False, sites: bool = False, chunk: int = 1 << 20) -> DataFrame:
    """(seq_id, motif, pos, reverse, score) of the windows that score at least the threshold.

    best_only: the best window of each sequence and motif only, the first and forward one of equal ones. located: with the
    motif's width and the sequence's length and weight, which is a column of ``sequences`` then. sites: with the window's letters,
    as they stand. The motifs are broadcast with the function; they are a few hundred numbers each. Sequences are scanned in parts of about ``chunk`` letters, so memory
    doesn't grow with the length of a sequence.
    """
    least = threshold if isinstance(threshold, dict) else {m.name: -np.inf if threshold is None else threshold for m in motifs}

    def windows(codes, offsets, m):
        """(row, place, score, reverse) of a batch's hits, a part at a time."""
        for low, high, start, stop in _tiles(offsets, len(m), chunk):
            part = codes[start : min(stop + len(m) - 1, int(offsets[high]))]
            value, reverse = both_strands(part, m)
            at = np.flatnonzero(value[: stop - start] >= least[m.name])
            row = low + np.searchsorted(offsets[low : high + 1], at + start, side="right") - 1
            inside = at + start + len(m) <= offsets[row + 1]
            at, row = at[inside], row[inside]
            if best_only:
                lead = _best(row, at, value[at])
                at, row = at[lead], row[lead]
            if len(at):
                yield row, at + start, value[at], reverse[at]

    def found(batches):
        for batch in batches:
            codes, offsets = numbered(batch.column("seq"))
            ids = batch.column("seq_id").to_numpy(zero_copy_only=False)
            for m in motifs:
                parts = windows(codes, offsets, m)
                if best_only and (every := list(parts)):  # parts of one sequence have a best window each
                    joined = [np.concatenate(x) for x in zip(*every, strict=True)]
                    lead = _best(joined[0], joined[1], joined[2])
                    parts = [[x[lead] for x in joined]]
                for row, at, value, reverse in parts:
                    columns = [pa.array(ids[row]), pa.array([m.name] * len(at)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(reverse), pa.array(value)]
                    names = ["seq_id", "motif", "pos", "reverse", "score"]
                    if located:
                        columns += [pa.array(np.full(len(at), len(m), dtype=np.int32)), pa.array(np.diff(offsets)[row].astype(np.int32)), batch.column("weight").take(pa.array(row))]
                        names += ["width", "seq_len", "weight"]
                    if sites:
                        letters = _LETTER[codes[at[:, None] + np.arange(len(m))]].tobytes()
                        cuts = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(len(m)))
                        columns.append(pa.StringArray.from_buffers(len(at), cuts, pa.py_buffer(letters)))
                        names.append("site")
                    yield pa.RecordBatch.from_arrays(columns, names)

    columns = ["seq_id", "seq", F.col("weight").cast("double").alias("weight")] if located else ["seq_id", "seq"]
    return sequences.select(*columns).mapInArrow(found, (LOCATED if located else HITS) + (", site string" if sites else ""))


def best_hits(hits: DataFrame) -> DataFrame:
    """The best hit of each sequence and motif: the greatest score, then the first place, then the forward strand."""
    best = F.max_by(F.struct("pos", "reverse", "score"), F.struct("score", -F.col("pos"), ~F.col("reverse")))
    return hits.groupBy("seq_id", "motif").agg(best.alias("b")).select("seq_id", "motif", "b.pos", "b.reverse", "b.score")
