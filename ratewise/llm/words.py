"""Words of whole texts as 64-bit hashes: Arrow string columns in, numpy arrays out, no Python object per word.

A column is walked in slices of whole texts of about ``SLICE`` bytes (one longer text is a slice of its own), so the
arrays of a task stay small whatever the batch holds. Hashes depend on the words alone, never on the place or task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spaced() -> np.ndarray:
    """Bytes of words between ASCII white space (space, tab to carriage return); 0 for a byte outside words."""
    table = np.arange(256, dtype=np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of words of ASCII letters (lower-cased), digits and anything beyond ASCII; 0 for a byte outside words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    outside = np.ones(256, bool)
    outside[48:58] = outside[65:91] = outside[97:123] = False
    outside[128:] = False
    table[outside] = 0
    return table


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``, hashes, and for each text the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # texts + 1: words of text i are offsets[i]:offsets[i + 1]
    byte_offsets: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


class Splitter:
    """Finds and hashes the words that a byte table defines."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.inside = table > 0
        # NUL is a word byte of `spaced` texts; it maps to 0 like a delimiter, so the mask is kept apart.
        if table[32] == 0 and table[1] == 1 and not self.inside[0]:
            self.inside[0] = True
        self.values = mix(np.arange(256, dtype=U)[table] * U(0x9E3779B97F4A7C15) + U(0x1234567))
        self.values[~self.inside] = 0
        self.powers = self.inverses = np.empty(0, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            r = 0xD1342543DE82EF95
            inverse = pow(r, -1, 1 << 64)
            n = max(n, SLICE + 1)
            self.powers, self.inverses = np.full(n, r, U), np.full(n, inverse, U)
            for x in (self.powers, self.inverses):
                x[0] = 1
                np.cumprod(x, dtype=U, out=x)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U))

    def __call__(self, data: np.ndarray, byte_offsets: np.ndarray) -> Words:
        n = len(data)
        inside = self.inside[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = byte_offsets[(byte_offsets > 0) & (byte_offsets < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return Words(data, starts, ends, self.hashes(data, starts, ends), np.searchsorted(starts, byte_offsets), byte_offsets)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte offsets) of consecutive texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a left part followed by a right part."""
    return mix(left * U(0x9E3779B97F4A7C15) + (right ^ U(0xD6E8FEB86659FD93)))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words; position i stands for words i to i + length - 1, across texts too."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, U)
    if length == 1:
        return hashes
    half = length // 2
    return joined(windows(hashes, half)[:n], windows(hashes, length - half)[half : half + n])


def inside_texts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` words that lie within one text."""
    starts = np.arange(max(0, int(offsets[-1]) - length + 1))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(starts)]
    return starts[starts + length <= offsets[owner + 1]]


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
