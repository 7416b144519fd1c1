"""Vectorised words, lines and word windows of many texts at once, for use inside tasks.

A slice of an Arrow string column is one run of UTF-8 bytes with row offsets. White space is
ASCII here (0x20, 0x09 to 0x0D), so words are found on bytes. A word's 64-bit hash is a
polynomial over its bytes modulo 2**64, read off one running sum and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def keep_heap() -> None:
    """Make the C allocator keep freed arrays of up to 30 MB instead of giving their pages back: it does so once it has freed one."""
    np.empty(30 << 20, np.uint8)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64; the longest asked for so far is kept, up to a slice's length."""
    kept = _powers.get(base)
    if kept is None or len(kept) <= n:
        kept = np.full(n + 1, base, np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = kept
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within the bytes); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Texts:
    """The words of a slice: byte starts and ends, and each row's range of words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False) -> None:
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.at, self._sums = data, at, None
        n = len(data)
        edge = at[:-1][at[:-1] < n]
        word = ~SPACE[data]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[edge] = False
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after[edge[edge > 0] - 1] = False
        self.word = word
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        #: Row i has the words first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, at)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * powers(_BASE, n)[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * powers(_INVERSE, n)[start])

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each run of ``width`` words within one row, first window of each row)."""
        counts = np.maximum(self.n_words - width + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        if not first[-1]:
            return np.zeros(0, np.uint64), first
        m = len(hashes) - width + 1
        total = hashes[:m] * _ODD[0]
        for k in range(1, width):
            total = total + hashes[k : m + k] * _ODD[k]
        keep = np.zeros(m + 1, np.int64)  # which of the m runs stay inside a row
        has = counts > 0
        np.add.at(keep, self.first[:-1][has], 1)
        np.add.at(keep, (self.first[:-1] + counts)[has], -1)
        return mix(total[np.cumsum(keep)[:m] > 0]), first

    def per_row(self, values: np.ndarray, positions: np.ndarray | None = None) -> np.ndarray:
        """Sum of ``values`` (one a byte) over each row."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def repeats(row: np.ndarray, key: np.ndarray, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its (row, key) occur more than once, and is it a later occurrence."""
    n = len(key)
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return again, later
    order = np.argsort(mix(key + row.astype(np.uint64) * _ODD[9]), kind="stable")
    k, r = key[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def spread(flags: np.ndarray, width: int, starts: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie in a flagged window; ``starts`` is each window's first word."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts[flags], 1)
    np.add.at(edge, starts[flags] + width, -1)
    return np.cumsum(edge)[:n_words] > 0
