"""Vectorised words and word-sequence hashes over Arrow text columns (NumPy on the UTF-8 bytes).

A word is a maximal run of bytes for which a 256-entry table is true. Hashes are polynomials modulo 2**64
over random per-byte values, taken as differences of running sums, so that a whole batch of documents is
hashed by a few array operations whatever its word lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once; a longer document is worked on alone.
SLICE_BYTES = 2 << 20

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32


def _odd(rng: np.random.Generator) -> int:
    return int(rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1 & (2**64 - 1)


class Hasher:
    """One family of 64-bit hashes of words and of word sequences, fixed by its seed."""

    def __init__(self, seed: int, lower: bool):
        rng = np.random.default_rng(seed)
        values = rng.integers(1, 2**64, 256, dtype=np.uint64)
        self.values = values[_LOWER] if lower else values
        self.base, self.step = _odd(rng), _odd(rng)
        self._powers: dict[int, np.ndarray] = {}

    def powers(self, base: int, n: int) -> np.ndarray:
        have = self._powers.get(base)
        if have is None or len(have) < n:
            have = np.full(max(n, 1 << 16), U64(base))
            have[0] = 1
            np.multiply.accumulate(have, out=have)
            self._powers[base] = have
        return have[:n]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.values[data] * self.powers(pow(self.base, -1, 2**64), len(data)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.powers(self.base, len(data) + 1)[starts])

    def windows(self, words: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of so many words that start at each word (or at the given ones)."""
        n = len(words)
        if n < width:
            return np.zeros(0, U64)
        sums = np.zeros(n + 1, U64)
        np.cumsum(words * self.powers(pow(self.step, -1, 2**64), n), out=sums[1:])
        if at is None:
            return mix((sums[width:] - sums[:-width]) * self.powers(self.step, n)[: n - width + 1])
        return mix((sums[at + width] - sums[at]) * self.powers(self.step, n)[at])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    _, offs, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of runs of rows with about so many bytes."""
    if not len(column):
        return
    data, offsets = flat(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of all rows, and for each row (and the end) its first word's number."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]  # rows lie side by side: a word ends where its row ends
    first[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)
