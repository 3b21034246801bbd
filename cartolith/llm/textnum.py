"""Word boundaries and word hashes of whole Arrow string batches, vectorised with numpy.

A word is a run of bytes other than space and 0x09-0x0D; those bytes never occur inside a
multi-byte UTF-8 character, so words can be cut on bytes. Hashes are 64-bit polynomials over a
fixed random byte table, read off prefix sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded into 64-bit arrays at a time.
CHUNK_BYTES = 1 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_tables = [np.random.Generator(np.random.PCG64(7 + lane)).integers(0, 2**64, 256, dtype=np.uint64) for lane in (0, 1)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's multiplier and of its inverse modulo 2**64, at least n of them."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        base = _MULTIPLIERS[lane]
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = _powers[lane] = (np.cumprod(up), np.cumprod(down))
    return have


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal runs have equal hashes wherever they stand."""
    up, down = powers(lane, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """Words of several documents: byte spans into data, and for each document its first word's index."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    rows: range

    def hashes(self, lane: int = 0) -> np.ndarray:
        return spans_hash(_tables[lane][self.data], self.starts, self.ends, lane)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word, the index of its document in rows."""
        return np.repeat(np.arange(len(self.rows)), self.counts())


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null has no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def words_of(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Words of all rows, in runs of rows of about CHUNK_BYTES; a longer text is one run."""
    if len(column) == 0:
        return
    offsets, data = string_buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, len(column))
        low = offsets[row]
        part = data[low : offsets[stop]]
        if lower:
            part = part + np.uint8(32) * ((part >= 65) & (part <= 90)).astype(np.uint8)
        bounds = offsets[row : stop + 1] - low
        inside = np.ones(len(part) + 1, dtype=bool)
        inside[:-1] = (part != 32) & ((part < 9) | (part > 13))
        inside[-1] = False
        begins = np.zeros(len(part) + 1, dtype=bool)
        begins[bounds] = True
        before = np.zeros(len(part) + 1, dtype=bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | begins))
        ends = np.flatnonzero(before & (~inside | begins))
        yield Words(part, starts, ends, np.searchsorted(starts, bounds), range(row, stop))
        row = stop


def windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of so many words that lie in one document, and their documents."""
    counts = np.maximum(words.counts() - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + words.first[owner]
    return begin, owner
