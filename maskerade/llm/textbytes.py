"""Whole-batch work on UTF-8 text in numpy: words, hashes of any stretch of bytes, pieces of an Arrow column.

Batches are cut into slabs of a few hundred kB of whole texts, so that temporary arrays stay in cache and memory is
bounded by the longest single text.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLAB = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_STEP, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_values(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed))


_BYTE = byte_values(1)


def _trim() -> None:
    """Gives memory that is free back to the system; a worker that is used again would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(work: Callable) -> Callable:
    """For what a Python worker runs over a partition or a group: trims at the end."""
    if inspect.isgeneratorfunction(work):

        @functools.wraps(work)
        def run(*args, **options):
            try:
                yield from work(*args, **options)
            finally:
                _trim()
    else:

        @functools.wraps(work)
        def run(table, *rest):  # Spark counts the arguments
            try:
                return work(table, *rest)
            finally:
                _trim()

    return run


class Hasher:
    """64-bit hashes of stretches [a, b) of a buffer, from one running sum."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = _BYTE):
        p, self._back = _grown(len(buf) + 1)
        self._sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * p[: len(buf)], out=self._sum[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self._sum[b] - self._sum[a]) * self._back[a]
        return mixed(h + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def raw_windows(self, k: int) -> np.ndarray:
        """Hash of each k bytes, by start."""
        n = len(self._sum) - k
        return mixed((self._sum[k:] - self._sum[:n]) * self._back[:n]) if n > 0 else np.zeros(0, np.uint64)


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word. ``starts`` are where texts begin; words don't cross texts."""
    inside = ~SEPARATOR[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = starts[(starts > 0) & (starts < len(buf))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def combined(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several in a row."""
    h = hashes[0]
    for x in hashes[1:]:
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + x)
    return h


def raw_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, n + 1 offsets and null flags of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    null = np.asarray(column.is_null()) if column.null_count else np.zeros(len(column), bool)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf, offsets, null


def slabs(offsets: np.ndarray, size: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``size`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
