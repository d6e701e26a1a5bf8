"""Vectorised word and window hashes over whole Arrow text columns, for use inside Spark tasks.

Texts are handled as UTF-8 bytes in pieces of a bounded number of bytes.  A prefix sum of byte codes times powers
of an odd base gives the hash of any byte range in constant time: hash(s, e) = (P[e] - P[s]) * base^-s mod 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
#: Bytes that are worked on at once.  Arrays over them take about a hundred times as much.
PIECE = 1 << 18
WHITE = bytes([32, *range(9, 14)])
#: Everything but digits, letters and bytes of non-ASCII characters.
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread every input bit over 64 output bits."""
    h = h ^ np.uint64(seed * 0xD1B54A32D192ED03 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64), 77) | np.uint64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


CODES, LOWER_CODES = _codes(False), _codes(True)


class Powers:
    """Powers of the base and of its inverse, grown as longer pieces come."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), PIECE + 1)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                np.multiply.accumulate(table, out=table)
                setattr(self, name, table)
        return self.up, self.down


@dataclass
class Piece:
    """Some consecutive texts of a batch: ``data`` holds their bytes, ``starts`` where each begins (and the end)."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def count(self) -> int:
        return len(self.starts) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.starts[i + 1]].tobytes()


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """Cut a text column into pieces of about ``limit`` bytes (one longer text makes a piece of its own).

    A missing text counts as empty.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield Piece(at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        at = end


def prefix_sums(data: np.ndarray, powers: Powers, codes: np.ndarray = CODES) -> np.ndarray:
    up, _ = powers.upto(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * up[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers.down[start])


@dataclass
class Words:
    """Word hashes of a piece with their byte ranges; ``bounds`` cuts them by text."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def words(piece: Piece, powers: Powers, separators: bytes) -> Words:
    """Maximal runs of bytes outside ``separators`` in lower case (A-Z only); no word crosses texts."""
    separator = np.zeros(256, dtype=bool)
    separator[list(separators)] = True
    inside = ~separator[piece.data]
    n = len(inside)
    first = np.zeros(n + 1, dtype=bool)
    first[:n] = inside
    first[1:n] &= ~inside[:-1]
    last = np.zeros(n + 1, dtype=bool)
    last[1:] = inside
    last[1:n] &= ~inside[1:]
    cuts = piece.starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts - 1]]
    first[both] = True
    last[both] = True
    start, end = np.flatnonzero(first[:n]), np.flatnonzero(last)
    return Words(_word_hashes(piece.data, start, end, powers), start, end, np.searchsorted(start, piece.starts))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers, limit: int = 1 << 21) -> np.ndarray:
    """Hashes of ascending byte ranges, for a long text block by block, so that sums and powers stay short."""
    if len(data) <= limit:
        return span_hashes(prefix_sums(data, powers, LOWER_CODES), powers, start, end)
    hashes, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + limit, side="right")))
        low, high = int(start[at]), int(end[stop - 1])
        sums = prefix_sums(data[low:high], powers, LOWER_CODES)
        hashes[at:stop] = span_hashes(sums, powers, start[at:stop] - low, end[at:stop] - low)
        at = stop
    return hashes


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, whatever text they belong to; shorter input gives nothing."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(BASE) + hashes[j:j + n]
    return mix(total, k)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Text index of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
