"""Vectorised text kernels that run inside Arrow tasks.

They work on the UTF-8 buffer of an Arrow string column, so no Python string is made for a row.
Word classes are sets of bytes: every class used here puts all code points above U+007F on one side,
so testing bytes and testing code points give the same words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 19

_byte = np.arange(256)
#: White space is U+0020 and U+0009 to U+000D; everything else is part of a word.
NOT_SPACE = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: After lower-casing A-Z: digits, a-z and everything above U+007F.
ALNUM = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_coefficients = np.zeros(0, U64)


def coefficients(n: int) -> np.ndarray:
    """The first n of a fixed sequence of odd 64-bit multipliers, one per byte position of a word."""
    global _coefficients
    if len(_coefficients) < n:
        size = max(256, 1 << (n - 1).bit_length())
        _coefficients = mix(np.arange(1, size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return _coefficients


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that gives its freed memory back at its end: Python workers live on and would else add it up over the stages."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (length n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES, most: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes and at most `most` rows each, at least one row; no row is cut."""
    n = len(offs) - 1
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1), lo + most)
        yield lo, hi
        lo = hi


def run_hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; the runs follow each other in `letters` and none is empty."""
    if not len(lengths):
        return np.zeros(0, U64)
    heads = np.cumsum(lengths) - lengths
    pos = np.arange(len(letters)) - np.repeat(heads, lengths)
    terms = coefficients(int(lengths.max()))[pos]
    terms *= letters.astype(U64) + U64(1)
    return mix(np.add.reduceat(terms, heads))


class Words:
    """The words of a block of texts: their byte ranges, lengths, the row each is in, and a 64-bit hash."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, klass: np.ndarray, lower: bool = True):
        """offs are relative to raw and cover whole rows."""
        raw = raw[offs[0] : offs[-1]]
        offs = offs - offs[0]
        self.raw = LOWER[raw] if lower else raw
        inside = klass[self.raw]
        n = len(raw)
        begins = np.zeros(n + 1, bool)
        ends = np.zeros(n + 1, bool)
        if n:
            begins[:n] = inside
            begins[1:n] &= ~inside[:-1]
            ends[1:] = inside
            ends[1:n] &= ~inside[1:]
            edge = offs[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            both = edge[inside[edge - 1] & inside[edge]]
            begins[both] = True
            ends[both] = True
        self.starts = np.flatnonzero(begins)
        self.stops = np.flatnonzero(ends)
        self.lengths = self.stops - self.starts
        #: words of row i are numbered first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, offs)
        self.letters = self.raw[inside] if n else self.raw
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = run_hashes(self.letters, self.lengths)
        return self._hash

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each row, and their first index per row (length n + 1).

    A row with fewer words, but not none, has one shingle of all its words.
    """
    h, counts = words.hashes, words.counts
    n_out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(n_out)))
    total = int(first[-1])
    if not total:
        return np.zeros(0, U64), first
    at = np.repeat(words.first[:-1] - first[:-1], n_out) + np.arange(total)
    room = np.repeat(words.first[1:], n_out)
    out = np.zeros(total, U64)
    c = coefficients(size + 256)
    last = len(h) - 1
    short = bool((counts < size).any())
    for j in range(size):
        part = h[np.minimum(at + j, last)] * c[200 + j]
        if short:
            part[at + j >= room] = 0
        out += part
    return mix(out), first


def digest_pair(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's sequence of values."""
    n = len(first) - 1
    a, b = np.zeros(n, U64), np.zeros(n, U64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        counts = np.diff(first)
        pos = np.arange(len(values)) - np.repeat(first[:-1], counts)
        c = coefficients(int(counts.max()) + 1)
        v = mix(values) | U64(1)
        a[full] = np.add.reduceat(v * c[pos], first[full])
        b[full] = np.add.reduceat((v ^ U64(0x5851F42D4C957F2D)) * c[pos + 1], first[full])
    size = np.diff(first).astype(U64)
    return mix(a + size), mix(b ^ (size << U64(20)))


def distinct(x: np.ndarray, counts: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values by sorting, and how often each occurs; for large integer arrays faster than numpy's hashing."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return (x[at], np.diff(np.append(at, len(x)))) if counts else x[at]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unit(seed: int, *keys: np.ndarray) -> np.ndarray:
    """Reproducible draws in [0, 1) from 64-bit keys."""
    x = mix(np.asarray(keys[0]).astype(np.int64).view(U64) + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for k in keys[1:]:
        x = mix(x ^ np.asarray(k).astype(np.int64).view(U64))
    return (x >> U64(11)).astype(np.float64) / float(1 << 53)
