r"""Words of whole Arrow text columns at numpy speed.

A word is a run of bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z: ASCII digits
and letters, and every byte of a character beyond ASCII. Runs never cross documents.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.zeros(256, np.uint8)
_LOWER[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_LOWER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[128:] = np.arange(128, 256)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives free memory back to the system when a task ends:
    Spark keeps its Python workers, and they would keep the memory of their largest task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            if len(_powers[0]) > 1 << 21:
                _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(max(n, 1 << 16), base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")  # this loads pandas
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """start and end: byte positions of each word in its chunk; rows: offsets of each row's words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray
    prefix: np.ndarray | None = None


def words(data: np.ndarray, offsets: np.ndarray, prefix: int = 0) -> Words:
    """Words of the rows that ``offsets`` delimits, with 64-bit hashes of their lower-cased bytes,
    and on demand of the first ``prefix`` of those."""
    base = int(offsets[0])
    low = _LOWER[data[base : int(offsets[-1])]]
    at = offsets - base
    n = len(low)
    is_word = low != 0
    first = np.empty(n + 1, bool)
    first[:n] = is_word
    first[1:n] &= ~is_word[: n - 1] if n else first[1:n]
    first[n] = False
    cut = at[:-1][at[:-1] < n]
    first[cut] = is_word[cut] if n else False
    last = np.empty(n + 1, bool)
    last[n] = bool(n and is_word[-1])
    last[0] = False
    if n:
        last[1:n] = is_word[: n - 1] & ~is_word[1:]
        inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
        last[inner] = is_word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _power(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    hashed = mixed((total[end] - total[start]) * inverse[start])
    head = mixed((total[np.minimum(end, start + prefix)] - total[start]) * inverse[start] + np.uint64(1)) if prefix else None
    return Words(start, end, hashed, np.searchsorted(start, at), head)
