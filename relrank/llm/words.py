"""Vectorised words and word shingles of a column of texts.

A word is a run of bytes outside space and \\t..\\r, with A-Z lower-cased. Words and shingles are represented by 64-bit
hashes; equal hashes are taken as equal words. Work goes through a column in slices of about a megabyte, so memory
stays small for any batch; only a single text longer than that makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_BYTES = np.arange(256, dtype=np.uint8)
IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_CONTINUATION = (_BYTES & 0xC0) == 0x80
_RANDOM = np.random.default_rng(20240607)
_BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(int(_RANDOM.integers(1 << 62, 1 << 63)) | 1)
_LANES = _RANDOM.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64)]


def small_batches(spark) -> None:
    """Texts go to Python a thousand at a time, so that a worker's memory does not depend on how many fit a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        steps = np.full(max(n, 1024), _STEP, np.uint64)
        steps[0] = 1
        _POWERS[0] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0]


def sorted_unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return starts, np.append(starts[1:], len(x))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]), ends - ends[0]


@dataclass
class Slice:
    """Some neighbouring rows: their texts' bytes, where each row starts, and the rows' numbers in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    data, offsets = column_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield Slice(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


@dataclass
class Words:
    """Hash of each word, byte range of each word, and the words' range of each row."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row_starts: np.ndarray  # one more than rows


def run_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends at its row's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    starts[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; the ranges must not be empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inner = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    codes = _BYTE_CODES[data[inner + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[inner]
    return mix(np.add.reduceat(codes, firsts) ^ sizes.astype(np.uint64))


def words(part: Slice, lower: bool = True) -> Words:
    data = LOWER[part.data] if lower else part.data
    starts, ends = run_bounds(~IS_SPACE[data], part.offsets)
    return Words(hash_ranges(data, starts, ends), starts, ends, np.searchsorted(starts, part.offsets, "left"))


@dataclass
class Sequence:
    """Hashes in text order for each row."""

    hashes: np.ndarray
    row_starts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_starts) - 1), np.diff(self.row_starts))


def shingles(found: Words, size: int = SHINGLE) -> Sequence:
    """Every run of `size` words in order; a row with fewer words has one shingle of them all, one without has none."""
    counts = np.diff(found.row_starts)
    n = len(found.hashes)
    rolled = np.zeros(n, np.uint64)
    for i in range(size):
        if n > i:
            rolled[: n - i] += found.hashes[i:] * _LANES[i]
    whole = np.maximum(counts - size + 1, 0)
    out = np.where(counts > 0, np.maximum(whole, 1), 0)
    row_starts = np.concatenate([[0], np.cumsum(out)])
    at = np.arange(row_starts[-1]) + np.repeat(found.row_starts[:-1] - row_starts[:-1], out)
    hashes = rolled[at] if n else np.zeros(0, np.uint64)
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        own = found.hashes[found.row_starts[row] : found.row_starts[row + 1]]
        hashes[row_starts[row]] = np.append(own * _LANES[: len(own)], _LANES[32 + len(own) : 33 + len(own)]).sum()
    return Sequence(mix(hashes), row_starts)


def distinct(found: Sequence) -> Sequence:
    """Each row's hashes once, in ascending order."""
    rows = found.rows
    order = np.lexsort((found.hashes, rows))
    hashes, rows = found.hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return Sequence(hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=len(found.row_starts) - 1))]))


def row_sums(values: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Wrapping sums of each row's values; 0 for a row without any."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[row_starts[1:]] - total[row_starts[:-1]]


def digests(found: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each row's set (signed)."""
    first = mix(row_sums(mix(found.hashes ^ _LANES[40]), found.row_starts))
    second = mix(row_sums(mix(found.hashes ^ _LANES[41]), found.row_starts))
    return first.view(np.int64), second.view(np.int64)
