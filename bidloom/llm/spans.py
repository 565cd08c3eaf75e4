"""Words and byte hashes of many texts at once, over the buffers of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers = (np.ones(1, U64), np.ones(1, U64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 20), base, U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The column in runs of whole texts of about `limit` bytes: first row, bytes, and where each text begins and ends.

    A null text is an empty one. A longer text is a run of its own.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield start, data[bounds[start]:bounds[stop]], bounds[start:stop + 1] - bounds[start]
        start = stop


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's range in them (n + 1 marks)."""
    n = len(data)
    solid = ~_SPACE[data]
    before = np.ones(n + 1, bool)
    before[1:] = ~solid
    before[bounds] = True
    starts = np.flatnonzero(solid & before[:n])
    after = np.ones(n + 1, bool)
    after[:n] = ~solid
    after[bounds] = True
    ends = np.flatnonzero(solid & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word with A-Z in lower case."""
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[_LOWER[data]] * power, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and each text's range in them; a text with fewer words is one run, with none no run."""
    starts, ends, first = words(data, bounds)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    marks = np.concatenate([[0], np.cumsum(runs)])
    base = np.repeat(first[:-1] - marks[:-1], runs) + np.arange(marks[-1])
    length = np.repeat(np.minimum(count, size), runs)
    out = length.astype(U64) * U64(0xA0761D6478BD642F)
    for k in range(size):
        inside = length > k
        step = mix(out + h[np.minimum(base + k, max(len(h) - 1, 0))] * U64(2 * k + 3)) if len(h) else out
        out = np.where(inside, step, out)
    return out, marks


def distinct_runs(values: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within every range: the distinct values in ascending order, and the new ranges."""
    parts, sizes = [], []
    for a, b in zip(marks[:-1].tolist(), marks[1:].tolist()):
        x = np.sort(values[a:b])
        x = x[np.concatenate([[True], x[1:] != x[:-1]])] if b > a else x
        parts.append(x)
        sizes.append(len(x))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def range_sums(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sum of every range, modulo 2**64; an empty range sums to zero."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[marks[1:]] - total[marks[:-1]]
