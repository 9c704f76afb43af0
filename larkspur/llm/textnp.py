"""Vectorised work on the texts of an Arrow batch: words, word hashes, hashes of runs of words.

Everything works on the UTF-8 bytes of many texts at once. Hashes are 64-bit polynomials modulo 2^64,
finished by an avalanche step; memory is bounded by the slice size, or by the longest single text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial hashes (fixed values).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BLOCK = 1 << 20

#: Separators of the word definitions, by byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and the same of its inverse, modulo 2^64; kept between calls up to a bound."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row bounds, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, bounds, data = column.buffers()
    offs = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def row_slices(offs: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most about limit bytes each; a longer text stands alone."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


@dataclass
class Words:
    """Words of several texts: byte positions, and for each text the index of its first word (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def split(data: np.ndarray, offs: np.ndarray, separators: np.ndarray, lower: bool) -> Words:
    """The maximal runs of bytes outside separators, text by text."""
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offs[1:][offs[1:] > 0] - 1
    ends[edge] = inside[edge]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offs))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte span; spans are disjoint and in order. Works in blocks of about BLOCK bytes."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(end, base + BLOCK, "right")))
        s, e = start[at:to] - base, end[at:to] - base
        n = int(e[-1])
        up, down = powers(BYTE_BASE, n)
        total = np.zeros(n + 1, U)
        np.cumsum((data[base : base + n].astype(U) + U(1)) * up[:n], out=total[1:])
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        at = to
    return out


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes, also across texts; the caller drops those."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    up, down = powers(WORD_BASE, len(hashes))
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:count]) * down[:count])


def run_minimum(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    count, width = len(values) - n + 1, 1
    if count <= 0:
        return values[:0]
    while 2 * width <= n:
        values = np.minimum(values[: len(values) - width], values[width:])
        width *= 2
    return np.minimum(values[:count], values[n - width : n - width + count])


def starts_of_runs(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which word indices begin a run of n words inside one text."""
    last = np.repeat(first[1:], np.diff(first))[: max(0, total - n + 1)]
    return np.arange(len(last)) + n <= last
