"""Texts as flat UTF-8 bytes: what the Arrow operators of this subpackage share.

An Arrow string column already is one byte buffer with offsets, so a batch can be split into words, hashed and scored with
a few numpy passes and no Python object for a word. Batches are cut into chunks of about ``CHUNK`` bytes, so that the arrays
stay in cache and a worker's memory doesn't follow the batch size; a longer text is a chunk by itself and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that holds for the bytes in the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


DIGIT = byte_class((0x30, 0x39))
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
WORD = DIGIT | LETTER
SPACE = byte_class((0x09, 0x0D), (0x20, 0x20))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one array without nulls; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about ``limit`` bytes."""
    n = len(texts)
    if not n:
        return
    _, raw, body = texts.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1), low + 65536)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; a run ends where its text ends."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) >= n:
        return
    size = max(n, 2 * CHUNK)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    powers, inverses = np.full(size, _BASE, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
    powers[0] = inverses[0] = 1
    _powers, _inverse = np.cumprod(powers), np.cumprod(inverses)


class Hashes:
    """64-bit hashes of the bytes of any runs of a buffer, the same wherever a run stands.

    A polynomial in a fixed odd base: one prefix sum over the bytes, then a difference and an inverse power for each run. Runs
    of a thousand bytes and more can be made up that have equal hashes; where that matters, use ``distinct`` or ``equal``.
    """

    def __init__(self, data: np.ndarray):
        _grow(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * _inverse[starts])


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hashes(data)(starts, ends)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs, one after the other: start, start + 1, ... of each."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each run are those of the other run beside it."""
    size = ends - starts
    same = size == other_ends - other_starts
    at = np.flatnonzero(same)
    unlike = data[spread(starts[at], size[at])] != other[spread(other_starts[at], size[at])]
    if unlike.any():
        same[np.repeat(at, size[at])[unlike]] = False
    return same


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): a run for each distinct sequence of bytes, and the number of its sequence for every run.

    Runs with equal hashes are compared byte by byte, since there are texts made to have equal hashes.
    """
    _, first, code = np.unique(hash_runs(data, starts, ends), return_index=True, return_inverse=True)
    like = first[code]
    more = np.flatnonzero(like != np.arange(len(starts)))
    wrong = more[~equal(data, starts[more], ends[more], data, starts[like[more]], ends[like[more]])]
    if len(wrong):
        numbers: dict[bytes, int] = {}
        for i in wrong.tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in numbers:
                numbers[word] = len(first)
                first = np.append(first, i)
            code[i] = numbers[word]
    return first, code


def sums(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of n owners."""
    return np.bincount(owners, weights=values, minlength=n)[:n]
